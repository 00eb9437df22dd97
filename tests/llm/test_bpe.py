import hashlib
import random

import numpy as np
from public_tokenizers import path
from tokenizers import Tokenizer

from rowsift.llm import bpe_tree as B

FILE = path("word_bpe_49k.json")


def texts():
    r = random.Random(5)
    out = [None, "", " \n", "Hello, World!! it's  I'M　x", "J̌x É é İ ΣΣ", "<|endoftext|>a<|STARTOFTEXT|> b<|startoftext|>c.",
           "a‍b \U0001f600\U0001f601 1234.5, x.:y | z|", "a" * 9000, "aaab" * 3000 + " end.", "abc " + "".join(r.choice("abcdefgh") for _ in range(20000)) + " x",
           "éü" * 4000, "x" * 3000 + "<|endoftext|>" + "yz" * 4000, "".join(r.choice("etaoin .,'-0123é") for _ in range(5000)),
           "=" * 6000, "A" * 2100 + "́" + "B" * 2500]
    return out + ["".join(r.choice("abcde'.sS 1\n") for _ in range(r.randint(1, 60))) for _ in range(200)]


def test_equals_library(spark):
    tok = Tokenizer.from_file(FILE)
    rows = list(enumerate(texts())) + [(None, "x y"), (3, "again")]
    got = B.encode(spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, ids int"), FILE).collect()
    want = []
    for i, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), np.array(ids, "<u4").tobytes(), tok.decode(ids, skip_special_tokens=False)))
    key = lambda x: (str(x[0]), hashlib.sha256(bytes(x[2])).hexdigest())
    for g, w in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert (g[0], g[1], bytes(g[2]), g[3]) == w, w[0]


def test_tree_equals_whole_word():
    enc, r = B.Encoder(open(FILE).read()), random.Random(2)
    for letters in ("ab", "etaoinshr", "abcdefghijklmnopqrstuvwxyz"):
        for n in (1, 5, 40, 333, 2000):
            word = "".join(r.choice(letters) for _ in range(n))
            for leaf in (3, 17, 128):
                a, b = B.tree_encode(enc.model, word, leaf), enc.model(word)
                assert a[0].tolist() == b[0].tolist() and a[1].tolist() == b[1].tolist()


def test_empty_table(spark):
    assert B.encode(spark.createDataFrame([], "doc_id long, text string"), FILE).count() == 0
