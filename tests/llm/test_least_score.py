"""The least score of the pipeline's language stage counts every held-out row."""

import numpy as np

from quernstone.llm import langid


class Field:
    langs = ["a"]

    def predict(self, texts):
        return [("b" if t.startswith("-") else "a", abs(float(t))) for t in texts]


def test_all_held_out_rows_count(spark):
    rng = np.random.default_rng(2)
    rows = [(i, repr(float(x if i % 10 else -x)), "a" if i % 50 else None) for i, x in enumerate(1 - rng.random(9000) ** 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    held = {r.doc_id for r in docs.where(langid.held_out()).select("doc_id").collect()}
    want = [float(t) for i, t, lang in rows if i in held and lang and not t.startswith("-")]
    assert len(want) > 2000 and langid.least_score(docs, Field()) == langid.PART * float(np.quantile(want, langid.LOWEST))
    assert langid.least_score(docs.where("lang IS NULL"), Field()) == 0.0
