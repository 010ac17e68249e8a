"""Whitening, vector codes and URL filters against brute force."""

import hashlib
import math
import random

import duckdb
import numpy as np
import pytest

from quernstone.llm import codes, queries, urlfilter, whitening

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>, label int, x string, code string, component string, n int"


def vector_rows(spark, rows, schema=VECTORS):
    return spark.createDataFrame([(i, v, label, "x", "c", "d", 1) for i, v, label in rows], schema)


def fitted_brute(vectors):
    x = np.floor(np.array(vectors, float) * 64) + 1_000_000
    v = np.cov(x.T, bias=True)
    return x, v, np.linalg.eigvalsh(v)[::-1]


def whitened_matrix(found, k):
    rows = {}
    for r in found:
        rows.setdefault(r.vec_id, {})[r.component] = r
    assert all(set(r) == set(range(1, k + 1)) for r in rows.values())
    return rows


def test_whitening_equals_brute_force_with_a_block_narrower_than_the_dimensions(spark):
    rng = np.random.default_rng(3)
    vectors = (rng.standard_normal((400, 24)) * np.linspace(3, 0.2, 24)).astype(np.float32)
    rows = vector_rows(spark, [(i, [float(c) for c in v], 0) for i, v in enumerate(vectors)]).repartition(5)
    x, v, values = fitted_brute(vectors)
    fitted = whitening.fit(rows, 4, block=6)
    assert fitted.passes > 1 and fitted.n == 400 and np.allclose(fitted.values, values[:4], rtol=1e-12)
    for e, c in zip(fitted.values, fitted.components.T):
        assert np.linalg.norm(v @ c - e * c) < 1e-10 * values[0] and abs(c @ c - 1) < 1e-12
    got = whitened_matrix(whitening.whiten(rows, 4, fitted=fitted).collect(), 4)
    white = np.array([[got[i][c].whitened for c in range(1, 5)] for i in range(400)])
    assert np.allclose(np.cov(white.T, bias=True), np.eye(4), atol=1e-9)
    n, s = 400, x.sum(0)
    for i in range(400):
        assert int(got[i][1].deviation) == sum(int(c) ** 2 for c in (n * x[i] - s)) and got[i][2].n == 400
    assert math.isclose(got[0][3].explained, values[2] / np.trace(v), rel_tol=1e-9) and got[0][1].identity_error < 1e-9


def test_whitening_widens_a_block_whose_eigenvalues_are_close(spark):
    rng = np.random.default_rng(4)
    vectors = rng.standard_normal((300, 40))
    fitted = whitening.fit(vector_rows(spark, [(i, v.tolist(), 0) for i, v in enumerate(vectors)], VECTORS.replace("float", "double")), 3, block=4)
    assert np.allclose(fitted.values, fitted_brute(vectors)[2][:3], rtol=1e-11) and fitted.passes < 60


def test_whitening_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(1, None, 0), (2, [1.0, None, 2.0], 0), (3, [nan, 0.0, 0.0], 0), (4, [inf, 0.0, 0.0], 0)]
    good = [(5, [0.5, -1.0, 2.0], 0), (5, [0.5, -1.0, 2.0], 0), (None, [1.0], 0), (6, [], None), (7, [0.0, 3.0, -0.01], 0)]
    found = whitening.whiten(vector_rows(spark, odd + good)).collect()
    x, _, values = fitted_brute([[0.5, -1, 2], [0.5, -1, 2], [1, 0, 0], [0, 0, 0], [0, 3, -0.01]])
    assert {r.n for r in found} == {5} and sorted(str(r.vec_id) for r in found if r.component == 1) == ["5", "5", "6", "7", "None"]
    assert max(r.component for r in found) == 3 and math.isclose(sum(r.explained for r in found if r.vec_id == 7), 1, rel_tol=1e-9)
    empty = next(r for r in found if r.vec_id == 6)
    assert int(empty.deviation) == sum(int(c) ** 2 for c in 5 * x[3] - x.sum(0))
    assert whitening.whiten(vector_rows(spark, [])).count() == 0 and whitening.whiten(vector_rows(spark, odd)).count() == 0
    assert whitening.whiten(vector_rows(spark, [(1, [1.0, 2.0], 0)] * 3)).count() == 0  # no variance


def test_deviations_beyond_a_long_are_exact(spark):
    rows = vector_rows(spark, [(1, [1e13], 0), (2, [-1e13], 0)], VECTORS.replace("float", "double"))
    assert {int(r.deviation) for r in whitening.whiten(rows).collect()} == {(2 * 64 * 10**13) ** 2}


def lloyd(rows, parts, entries, rounds):
    """Codes, errors and entries by whole passes in Python integers."""
    width = max((len(v) for _, v in rows), default=0)
    width = max(1, -(-width // parts)) * parts
    x = [[math.floor(1024 * c) for c in v] + [0] * (width - len(v)) for _, v in rows]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, x[i]))[:entries]
    size = width // parts
    piece = lambda v, p: v[p * size : (p + 1) * size]
    books = [[piece(x[i], p) for i in order] for p in range(parts)]
    near = lambda v, p: min((sum((a - b) ** 2 for a, b in zip(v, e)), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        for p in range(parts):
            held = {}
            for v in x:
                held.setdefault(near(piece(v, p), p)[1], []).append(piece(v, p))
            for k, vs in held.items():
                books[p][k] = [sum(c) // len(vs) for c in zip(*vs)]
    found = [[near(piece(v, p), p) for p in range(parts)] for v in x]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return ["".join(f"{k:02x}" for _, k in f) for f in found], [sum(d for d, _ in f) for f in found], digest


@pytest.mark.parametrize("entries", [5, 256])
def test_codes_equal_whole_lloyd_rounds(spark, entries):
    rng = random.Random(entries)
    rows = [(i, [round(rng.gauss(0, 1), 1) for _ in range(8)], rng.choice([0, 1, None])) for i in range(120)]
    rows += [(rng.randint(0, 119), [0.5] * 8, 2) for _ in range(60)]  # a common vector, ids repeat
    rows += [(None, [0.25, -0.5, 1.0], None), (500, [], 1)]
    odd = [(-5, None, 0), (-4, [1.0, None] * 4, 0), (-3, [float("nan")] * 8, 0), (-2, [float("-inf")] * 8, 0)]
    df = vector_rows(spark, rows + odd, VECTORS.replace("float", "double")).repartition(7)
    want, errors, digest = lloyd([(i, v) for i, v, _ in rows], 4, entries, 4)
    sums = {}
    for (_, _, label), e in zip(rows, errors):
        sums[label] = sums.get(label, 0) + e
    expected = sorted((str(i), c, e, sums[label], digest) for (i, _, label), c, e in zip(rows, want, errors))
    got = codes.compress(df, entries=entries).collect()
    assert sorted((str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in got) == expected
    assert any(e for e in errors) or entries == 256


def test_codes_with_more_labels_than_are_sent(spark, monkeypatch):
    monkeypatch.setattr(codes, "BROADCAST_LABELS", 1)
    rows = [(i, [float(i), 0.5], i % 3 or None) for i in range(30)]
    got = codes.compress(vector_rows(spark, rows), 2, 3, 2).collect()
    sums = {}
    for r in got:
        sums[rows[r.vec_id][2]] = sums.get(rows[r.vec_id][2], 0) + r.error
    assert len(got) == 30 and all(r.label_error == sums[rows[r.vec_id][2]] for r in got)


def test_codes_of_no_rows(spark):
    assert codes.compress(vector_rows(spark, [])).count() == 0 and codes.compress(vector_rows(spark, [(1, None, 0)])).count() == 0


def test_large_integers_are_compared_exactly():
    big = (1 << 27) - 1
    near, error = codes.assigned(np.array([[big] * 16], np.int64), np.array([[[-big] * 16, [-big] * 15 + [1 - big]]], np.int64))
    assert near[0, 0] == 1 and error[0, 0] == 15 * (2 * big) ** 2 + (2 * big - 1) ** 2


def judged(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min((path.index(c) for c in "?#" if c in path), default=len(path))]
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if h and p is not None and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else "allow"


RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"), ("a.b.com", "", "block"), ("b.com", "/", "allow"), ("example.org:80", "/", "block"), ("org", "x", "block"), ("É.net", "/", "block"), ("b.com", "/", "block")]
URLS = [None, "", "no scheme", "http://", "http:///x", "http://org/", "http://ORG/", "http://xorg/", "http://example.org", "http://example.org/en/12?x=/es/", "http://www.Example.org/es/", "http://www.example.org/es", "https://a.b.com", "https://x.a.b.com/q", "https://b.com/?", "http://example.org:80/en/1", "http://u@example.org/es/1#a", "http://orgx", "http://É.net/", "http://é.net/", "http://a..org/", "http://example.org./x", "x://y://example.org/es/", "http://fr.com/fr/\nline", "http://example.org/es/" + "a" * 50_000]


@pytest.mark.parametrize("sent", [100, 0])
def test_rules_equal_brute_force(spark, sent):
    rng = random.Random(1)
    made = [f"{rng.choice(['http', 'HTTPS'])}://{'.'.join(rng.choices(['a', 'b', 'com', 'org', 'example', 'WWW'], k=rng.randint(1, 4)))}{rng.choice(['', '/', '/en/1', '/es/', '/de/2', '/fr/'])}{rng.choice(['', '?a=/x', '#t'])}" for _ in range(600)]
    urls = URLS + made + ["http://hot.example.org/en/17"] * 300
    rows = spark.createDataFrame([(i if i % 50 else None, u, "h", "r") for i, u in enumerate(urls)], "page_id long, url string, host string, row string").repartition(6)
    rules = urlfilter.rule_rows(spark, [*RULES, ("", "/", "block"), (None, "/", "block"), ("org", None, "block"), ("com", "/fr/x", "perhaps")])
    got = sorted(map(str, (tuple(r) for r in urlfilter.judge(rows, rules, broadcast_rules=sent, salts=3).collect())))
    assert got == sorted(str((i if i % 50 else None, *judged(u, RULES))) for i, u in enumerate(urls))


def test_rules_of_none_and_pages_of_none(spark):
    pages = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    none = urlfilter.rule_rows(spark, [])
    assert [tuple(r) for r in urlfilter.judge(pages, none, "block").collect()] == [(1, "a.org", "/", None, "block")]
    assert urlfilter.judge(pages.limit(0), urlfilter.rule_rows(spark, RULES)).count() == 0


@pytest.mark.parametrize("name", ["op12_url_filter", "op13_vector_codes"])
def test_oracles(spark, name):
    db = duckdb.connect()
    for t in ("pages", "embeddings"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = queries.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = db.sql(f"SELECT {', '.join(columns)} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    assert sorted(str(tuple(r)) for r in got.select(*columns).collect()) == sorted(map(str, want))


def test_whitening_query(spark):
    found = queries.op11_embedding_whitening(spark, SF)
    assert dict(found.dtypes)["deviation"] == "bigint"
    rows = found.collect()
    n = spark.read.parquet(f"{SF}/embeddings.parquet").count()
    assert len(rows) == 32 * n and all(r.identity_error <= 1e-4 and r.deviation is not None for r in rows)
