import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from weftline.llm.id_index import IdIndex, PerfectHash, read_ids, write_ids

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_perfect_hash_is_minimal_and_perfect():
    h = np.random.default_rng(1).integers(0, 1 << 63, 20_000).astype(np.uint64)
    h = np.unique(h)
    slots = PerfectHash.build(h).slots(h)
    assert sorted(slots.tolist()) == list(range(len(h)))


def test_round_trip_and_keyed_access(spark, tmp_path):
    pick = random.Random(3)
    alphabet = "ab cdeTHE's'll 0123\n\t.,!?éßñ漢字😀 \xa0\x1cİΣς̀"
    texts = ["".join(pick.choice(alphabet) for _ in range(pick.randrange(0, 120))) for _ in range(200)]
    texts += ["", "<|endoftext|> x <|startoftext|>", "word, " * 3000, "don't we'll A.B., C!", "é Å"]
    rows = [(i * 3 - 40, t, 7) for i, t in enumerate(texts)] + [(5, "again", 7), (5, None, 7), (5, "again", 7), (None, "null", 7), (None, None, 7)]
    pick.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int").repartition(5)
    path = f"file://{tmp_path}/ids"
    starts = write_ids(docs, PATH, path)
    got = read_ids(docs, path, starts, with_ids=True).orderBy("start").collect()

    library = Tokenizer.from_file(PATH)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()))
    at = 0
    assert len(got) == len(order)
    for g, (i, t, _) in zip(got, order, strict=True):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        assert (g.doc_id, g.start, g.n_tokens, g.ids) == (i, at, len(ids), ids)
        assert g.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    index = IdIndex(path)
    assert index.get(-40).tolist() == [*library.encode(texts[0], add_special_tokens=False).ids, 1]
    assert index.get(5, 1) is not None and index.get(5, 9) is None and index.get(123456) is None and index.get(None, 1) is not None


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    path = f"file://{tmp_path}/ids"
    starts = write_ids(docs, PATH, path)
    assert read_ids(docs, path, starts).count() == 0
    assert IdIndex(path).get(1) is None
