import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import tiktoken

from weftline.llm.byte_bpe import byte_bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def reference(text):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    if not hasattr(reference, "enc"):
        reference.enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return reference.enc.encode_ordinary(text)


def test_ids_equal_the_library_and_decode_to_the_text(spark):
    pick = random.Random(5)
    alphabet = "ab cdeTHE'sll 0123\n\t\r  .,!?éßñ漢字😀̀  \x1c<|endoftext|>"
    texts = ["".join(pick.choice(alphabet) for _ in range(pick.randrange(0, 90))) for _ in range(300)]
    texts += ["", " ", "a" * 3000, "ab" * 2000, "!?" * 700, "the cat " * 500, "x́" * 400, " " * 900]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(9001, None, 1), (None, "null id", 1), (3, texts[3], 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    out = byte_bpe(df, PATH, public_tokenizers.PATTERN).collect()
    assert len(out) == len(rows)
    by_hash = sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out)
    want = []
    for i, t, _ in rows:
        ids = reference(t or "")
        want.append((i is None, i or 0, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert by_hash == sorted(want)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert byte_bpe(df, PATH, public_tokenizers.PATTERN).count() == 0
