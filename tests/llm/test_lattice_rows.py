"""op7's tables between its steps: small rows whatever the texts, and scores that put them together again."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from sediment.llm import common, lattice_lm


def test_no_row_grows_with_a_document_or_a_batch(spark, monkeypatch):
    tables, put = [], common.written
    monkeypatch.setattr(common, "written", lambda df, name: tables.append(put(df, name)) or tables[-1])
    words = [f"w{i}x" for i in range(7_500)]
    texts = [" ".join(words), " ".join(words[::-1]), " ".join(words[:3_700]), " ".join(words[3_700:]), "", "w1x w1x " + words[-1], " \n"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[0]), (None, "")]
    scores = lattice_lm.scores(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), public_tokenizers.path("piece_bpe_32k.model"))
    got = scores.collect()
    sizes = [t.agg(F.max(F.size(f.name))).first()[0] for t in tables for f in t.schema if isinstance(f.dataType, ArrayType)]
    assert 1 < max(sizes) <= 1_000
    assert "collect_list" not in scores._jdf.queryExecution().toString()

    n = {i: [r for r in got if r.doc_id == i] for i in [*range(len(texts)), None]}
    assert [[r.n_tokens for r in n[i]] for i in range(len(texts))] == [[7_501], [7_501], [3_701], [3_801], [1], [4], [1]]
    assert sorted(r.n_tokens for r in n[None]) == [1, 7_501] and all(r.n_known == r.n_tokens for r in got)
    for column in ("score", "base_score"):
        x = {i: n[i][0][column] for i in range(len(texts))}
        end = x[4]
        assert x[6] == end and x[0] == pytest.approx(x[1]) == pytest.approx(x[2] + x[3] - end) == pytest.approx(min(r[column] for r in n[None]))
        assert x[0] < x[2] < x[5] < end < 0
