"""The pipeline on a fixture, each stage held against a plain form of its operator on the stage's own input."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from tests.llm.test_jaccard_join import brute
from tests.llm.test_quality import make
from weftline.llm.mixing import mix_report
from weftline.llm.secrets import find_all, redact, trained

pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_equal_plain_forms(spark, tmp_path):
    pick = random.Random(1)
    rows, labels = [], []
    for i, text, good, _ in make(300):
        rows.append((i, text, pick.choice(["en", "de"]), f"src{i % 4}", len(text)))
        labels.append((i, good, 0))
        if i % 10 == 1:
            rows.append((1000 + i, text, "en", "src1", len(text)))
        if i % 10 == 3:
            text += " tok password=abc123def456 end"
            rows.append((2000 + i, text, "en", None, len(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    kept = []
    now = docs
    for k, (name, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, now, str(tmp_path))
        out.write.parquet(f"{tmp_path}/out{k}")
        now = spark.read.parquet(f"{tmp_path}/out{k}")
        kept.append(now.collect())
        if k < 4:
            assert now.columns == docs.columns, name
    good = {i for i, q, _ in labels if q}
    stay = {r.doc_id % 1000 for r in kept[0]}
    assert len(good - stay) <= 0.05 * len(good) and not {i for i, q, _ in labels if not q} & stay
    comps = {(c[2], c[3]) for c in brute([(r.doc_id, r.text) for r in kept[0]], 5, 80)}
    assert sorted((False, r.doc_id) for r in kept[1]) == sorted(comps)
    texts = {r.doc_id: r.text for r in kept[1]}
    for r in kept[2]:
        want = redact(texts[r.doc_id], find_all([texts[r.doc_id]], trained())[0])
        assert (r.text, r.n_chars) == (want, len(want)) and "abc123def456" not in r.text
    copies = {r.doc_id: r.copies for r in mix_report(spark.read.parquet(f"{tmp_path}/out2")).collect()}
    assert sorted(r.doc_id for r in kept[3]) == sorted(i for i, c in copies.items() for _ in range(c))
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = sorted((r.doc_id, hashlib.sha256(np.array(enc.encode_ordinary(r.text), "<u4").tobytes()).hexdigest()) for r in kept[3])
    assert sorted((r.doc_id, r.ids_sha256) for r in kept[4]) == want
    assert pipeline.run(spark, str(tmp_path)).count() == len(want)
