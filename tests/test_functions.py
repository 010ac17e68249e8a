import hashlib
import hmac
import json
import re
import tracemalloc
import unicodedata

import pyarrow as pa
from pyspark.sql import functions as F

from quernstone.functions import ids, text, values


def column(spark, value, make, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(make(F.col("x")).alias("y")).first().y


def test_normalize_and_fingerprint(spark):
    for raw in ("  Ｆｕｌｌ　width\x1c text ", "Straße ẞ\n\n", "", "ﬁ ne", "é"):
        want = re.sub(r"\s+", " ", unicodedata.normalize("NFKC", raw)).strip()
        assert column(spark, raw, text.normalize_text) == want
        assert column(spark, raw, lambda x: text.fingerprint(text.normalize_text(x))) == hashlib.sha256(want.casefold().encode()).hexdigest()
    assert column(spark, None, text.normalize_text) is None


def test_keyed_hash_equals_hmac(spark):
    for secret in (b"s" * 32, b"t" * 100):
        assert column(spark, "42", lambda x: ids.author_hash("github", x, secret)) == hmac.new(secret, b"github\x0042", hashlib.sha256).hexdigest()


def test_canonical_key(spark):
    for raw, want in (("authorID", "author_id"), ("SteamID", "steam_id"), ("HTMLTitle", "html_title"), ("--User Name--", "user_name")):
        assert column(spark, raw, text.canonical_key) == want


def test_html(spark):
    assert column(spark, "How to use &lt;dict&gt; &amp; <b>list</b>?", text.html_body_to_text) == "How to use <dict> & list?"
    assert column(spark, "<p>a  b</p><script>x</script><ul><li>c<li>d</ul>e<br>f", text.html_body_to_text) == "a b\nc\nde\nf"
    assert column(spark, "A &amp;quot;b&amp;quot;", text.html_title_to_text) == 'A "b"'


def test_contacts(spark):
    raw = "Mail a.b@example.org or +82 (2) 123-4567, (02) 123 4567, 010-1234-5678; CPV 48000000 on 2024-01-02."
    found = column(spark, raw, text.redact_contacts)
    assert found["count"] == 4 and "48000000" in found.text and "2024-01-02" in found.text
    assert column(spark, found.text, text.residual_contacts) == 0


def test_language(spark):
    for value, want in ((" direct ", "direct"), (["", "second"], "second"), ({"deu": "d", "ENG": ["", "e"]}, "e"), ({"fra": "f", "deu": [" d "]}, "d"), ({"en": " ", "zz": []}, ""), ({}, "")):
        assert column(spark, json.dumps(value), text.select_language) == want


def test_paths(spark):
    doc = json.dumps({"state": 1, "x": [{"userName": "n"}], "author": {"id": 1}})
    assert column(spark, doc, lambda x: text.identity_paths(text.key_paths(x))) == ["x[0].userName", "author"]


def test_times(spark):
    assert column(spark, 0, values.epoch_to_iso, "long") == "1970-01-01T00:00:00Z"
    assert column(spark, "2024-01-02T03:04:05+02:00", values.iso_to_utc) == "2024-01-02T01:04:05Z"
    assert column(spark, "2024-01-02T03:04:05", values.iso_to_utc) is None
    for raw, want in (("20240102", "2024-01-02"), ("2024-01-02+05:00", "2024-01-02"), ("2024-01-02", None), ("2024-13-02+05:00", None), ("02.01.2024", None)):
        got = column(spark, raw, values.notice_date)
        assert (got and got.isoformat()) == want
    assert column(spark, "2024-01-02", values.notice_published) == "2024-01-02T00:00:00Z"


def test_epoch_beyond_four_digits_of_years(spark):
    for seconds, want in ((253402300799, "9999-12-31T23:59:59Z"), (253402300800, "10000-01-01T00:00:00Z"), (8000000000000, "255479-11-28T14:13:20Z"), (-60000000000, "0068-09-03T13:20:00Z"), (-99999999999, "-1199-02-15T14:13:21Z")):
        assert column(spark, seconds, values.epoch_to_iso, "long") == want


def test_numbers_and_headers(spark):
    assert column(spark, 25, lambda x: values.required_capacity(x, 1.5), "long") == 38
    assert [column(spark, a, lambda x: values.backoff_seconds(x, 1, 8), "int") for a in (1, 2, 3, 4, 5)] == [1, 2, 4, 8, 8]
    row = spark.range(1).select(F.create_map(F.lit("X-RateLimit-Remaining"), F.lit(" 12 "), F.lit("Bad"), F.lit("x")).alias("h"))
    got = row.select(values.header_number(F.col("h"), "x-ratelimit-remaining").alias("a"), values.header_number(F.col("h"), "bad").alias("b"), values.header(F.col("h"), "none").alias("c")).first()
    assert (got.a, got.b, got.c) == (12, None, None)


def test_urls(spark):
    assert column(spark, "https://a.org/questions/1?x=2", lambda u: values.canonical_url(u, F.lit("a.org"), F.lit("/questions/"), "x"))
    for bad in ("http://a.org/questions/1", "https://b.org/questions/1", "https://a.org/q", "not a url", None):
        assert not column(spark, bad, lambda u: values.canonical_url(u, F.lit("a.org"), F.lit("/questions/")))
    assert column(spark, "https://example.org/x", values.is_public_http) and not column(spark, "http://localhost/x", values.is_public_http)


def test_dataset_digest_ignores_order(spark):
    rows = [(i, ids.canonical_json({"b": i, "a": "é"})) for i in range(9)]
    make = lambda r: ids.dataset_sha256(spark.createDataFrame(r, "id int, json string"), "id", "json").first()
    assert make(rows) == make(rows[::-1]) and make(rows).dataset_sha256 == hashlib.sha256("\n".join(j for _, j in rows).encode()).hexdigest()
    assert column(spark, '{"b": 1.50, "a": "é"}', ids.canonical_json_text) == '{"a":"é","b":1.5}'


def test_texts_of_a_batch_are_not_held_at_once():
    batch = pa.array(["Straße " * 1000] * 2000 + [None])  # 16 MB
    for function in (text.nfkc, text.casefold, text.folded_nfkc, text.text_fingerprint):
        tracemalloc.start()
        got = function.func(batch)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert len(got) == 2001 and got[2000].as_py() is None and peak < 8 << 20
    assert got[0].as_py() == hashlib.sha256(("strasse " * 1000).strip().encode()).hexdigest()
