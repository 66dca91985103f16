import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from vacancylake.llm.packing import WordTokenizer, best_fit, pack
from vacancylake.llm.registry import tokenizer_file

SCHEMA = "doc_id long, text string, lang string, bin long"


TOKENIZER = Tokenizer.from_file(tokenizer_file())


def plain_ids(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids + [1]


def test_places_hold_the_ids(spark):
    rng = random.Random(5)
    texts = [None, "", "  \n", "a<|endoftext|>b <|startoftext|> x", "Été d'été 3.14 don't", "Σας ΣΑΣ İi"]
    texts += [" ".join(rng.choice(["Abc", "the", "zzxy", "né", "10"]) for _ in range(rng.randrange(400))) for _ in range(60)]
    texts += ["long word " * 3000, "x" * 9000]
    rows = [(i, t, "en", 7) for i, t in enumerate(texts)] + [(3, texts[3], None, None), (None, "abc", None, None)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(6)
    got = pack(docs, tokenizer_file(), capacity=512, fan_in=2).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 512
    for i, text in enumerate(texts):
        ids = np.array(plain_ids(text), dtype="<u4")
        want = [(p, s, len(ids[s : s + 512]), zlib.crc32(ids[s : s + 512].tobytes())) for p, s in enumerate(range(0, len(ids), 512))]
        have = sorted((r.piece, r.start, r.length, r.ids_crc32) for r in by_doc[i])
        assert have == sorted(want * (2 if i == 3 else 1))
    total = sum(r.length for r in got)
    assert len(by_sequence) <= 1.1 * -(-total // 512)  # few documents in each partition
    assert len(by_doc[None]) == 1


def test_words_as_the_tokenizer_splits_them():
    rng = random.Random(11)
    signs = ["a", "B", "é", "W\u030a", "e\u0301", "'", "'s", "''", "n't", "'LL", "3", "42", ".", "),", "_", "\u2026", " ", "\n", "\u00a0", "\x0b",
             "<", "|", "<|endoftext|>", "\u0130", "\u03a3", "\u1100\u1161", "\u6f22", "\x00", "\x1f", "\x85"]
    texts = ["".join(rng.choice(signs[: 26 if n % 4 else len(signs)]) for _ in range(rng.randrange(30))) for n in range(3000)]
    texts = [t if n % 4 == 0 else t.replace("<|", "< ") for n, t in enumerate(texts)]
    for step in (1, 400):
        coder = WordTokenizer(tokenizer_file(), max_words=700)
        for at in range(0, 800 if step == 1 else 3000, step):
            part = texts[at : at + step]
            ids, bounds = coder.encode(pa.array([*part, None], pa.large_string()))
            for n, text in enumerate(part):
                assert ids[bounds[n] : bounds[n + 1]].tolist() == plain_ids(text)[:-1], text
            assert bounds[-1] == bounds[-2]


def test_empty_table(spark):
    assert pack(spark.createDataFrame([], SCHEMA), tokenizer_file()).collect() == []


@pytest.mark.parametrize("seed", range(4))
def test_best_fit_takes_the_fullest_bin(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, 33, 80)
    bins, places, fills = best_fit(sizes, 32)
    spaces = []
    for size in sorted(sizes, reverse=True):
        fitting = [s for s in spaces if s >= size]
        if fitting:
            spaces.remove(min(fitting))
            spaces.append(min(fitting) - size)
        else:
            spaces.append(32 - size)
    assert sorted(32 - fills) == sorted(spaces)
    assert all(fills[b] == sizes[bins == b].sum() for b in range(len(fills)))
