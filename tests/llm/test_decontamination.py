import random

import pyarrow as pa

from vacancylake.llm.decontamination import Search, leaks, normalized, without_leaks

DOCS = "doc_id long, text string, item_id long, edits int"
ITEMS = "item_id long, text string, doc_id int"
SEARCH = Search(piece=30, stride=15, budget=0.1, q=8)


def plain(text):
    out = ""
    for c in (text or "").lower():
        if c.isalpha() or c.isdigit():
            out += c
        elif out and out[-1] != " ":
            out += " "
    return out


def least_edits(piece, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(piece):
        new = [i + 1]
        for j, b in enumerate(text):
            new.append(min(row[j] + (a != b), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def brute_force(docs, items, search):
    out = set()
    for doc, text in docs:
        text = plain(text)
        for item, own in items:
            own = plain(own).rstrip(" ")
            starts = [*range(0, max(len(own) - search.piece, 0), search.stride), max(len(own) - search.piece, 0)]
            pieces = [own[s : s + search.piece] for s in starts]
            found = [least_edits(p, text) for p in pieces if p]
            fits = [e for e, p in zip(found, pieces) if e <= int(search.budget * len(p))]
            if len(own) <= search.piece and not int(search.budget * len(own)) and f" {own} " not in f" {text.rstrip(' ')} ":
                fits = []
            if fits:
                out.add((doc, item, min(fits)))
    return out


def edited(rng, text, n):
    signs = list(text)
    for _ in range(n):
        at = rng.randrange(len(signs))
        signs[at : at + 1] = rng.choice([[], ["z"], [signs[at], "q"]])
    return "".join(signs)


def corpus(rng):
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randrange(1, 7)))
    items = [(i, " ".join(word() for _ in range(rng.randrange(1, 20)))) for i in range(25)]
    items += [(30, "Ab, 12"), (31, "x"), (32, " !? "), (33, None), (34, ""), (3, items[3][1]), (35, "Ünïcode ß! " * 5)]
    docs = []
    for i in range(150):
        parts = [" ".join(word() for _ in range(rng.randrange(1, 25))) for _ in range(2)]
        if rng.random() < 0.7:
            own = rng.choice(items)[1] or ""
            own = edited(rng, own, rng.randrange(1, 6)) if len(own) > 5 and rng.random() < 0.6 else own
            parts.insert(1, own.upper() if rng.random() < 0.3 else own[rng.randrange(3) :])
        docs.append((i, rng.choice([" ", "... ", "\n"]).join(parts)))
    docs += [(200, None), (201, ""), (202, "!!"), (203, (items[5][1] + " ") * 400), (None, items[6][1]), (0, docs[0][1])]
    return docs, items


def test_normalized():
    texts = ["  A, b--c9!", None, "", "!x", "é٠ \U0001d400", "a", " "]
    codes, offsets = normalized(pa.array(texts, pa.large_string()))
    got = ["".join(map(chr, codes[a:b])) for a, b in zip(offsets[:-1], offsets[1:])]
    assert got == [plain(t) for t in texts]


def test_as_brute_force(spark):
    rng = random.Random(12)
    docs, items = corpus(rng)
    frame = spark.createDataFrame([(*d, 1, 2) for d in docs], DOCS).repartition(4)
    bench = spark.createDataFrame([(*i, 9) for i in items], ITEMS)
    want = brute_force(docs, items, SEARCH)
    for search in (SEARCH, Search(piece=30, stride=15, budget=0.1, q=8, block_chars=400)):
        got = leaks(frame, bench, search).collect()
        assert {(r.doc_id, r.item_id, r.edits) for r in got} == want
    assert len([1 for r in got if r.doc_id == 0]) == 2 * len([1 for w in want if w[0] == 0])
    held = {d for d, _, _ in want}
    clean = without_leaks(frame, bench, SEARCH)
    assert clean.columns == frame.columns
    assert sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(d) for d, _ in docs if d not in held)


def test_empty_tables(spark):
    none, items = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "abc abc", 0)], ITEMS)
    assert leaks(none, items).collect() == []
    docs = spark.createDataFrame([(1, "abc abc", 0, 0)], DOCS)
    empty = spark.createDataFrame([], ITEMS)
    assert leaks(docs, empty).collect() == [] and without_leaks(docs, empty).count() == 1
    assert without_leaks(docs, items).count() == 0


def test_partial_quotes_at_all_offsets(spark):
    rng = random.Random(5)
    signs = lambda letters, n: "".join(rng.choices(letters, k=n))
    item, short = signs("abcdefghijkl", 263), signs("abcdefghijkl", 90)
    docs, want = [], set()
    for size, edits in ((108, 0), (120, 0), (131, 12)):
        for start in range(len(item) - size + 1):
            quote = list(item[start : start + size])
            for at in rng.sample(range(size), edits):
                quote[at] = "z"
            docs.append((len(docs), f"{signs('mnopqrstuvw', 150)}{''.join(quote)}{signs('mnopqrstuvw', 150)}"))
            want.add((docs[-1][0], 1))
    docs += [(9001, signs("mnopqrstuvw", 80) + short[:81] + signs("mnopqrstuvw", 80)), (9002, item[:90])]
    frame = spark.createDataFrame([(*d, 1, 2) for d in docs], DOCS).repartition(4)
    found = leaks(frame, spark.createDataFrame([(1, item, 0), (2, short, 0)], ITEMS)).collect()
    assert {(r.doc_id, r.item_id) for r in found} == want | {(9001, 2)}
    own = [d for d in docs if d[0] % 40 == 0]
    exact = {(d, i, e) for d, i, e in brute_force(own, [(1, item)], Search())}
    assert {(r.doc_id, r.item_id, r.edits) for r in found if r.doc_id in {d for d, _ in own}} == exact


def test_short_items_as_whole_words(spark):
    items = [(1, "cat"), (2, "Yes"), (3, "a"), (4, "in the"), (5, "abcdefghi"), (6, "abcdefghij")]
    docs = [
        (1, "The concatenated words"), (2, "an eyesore; yesterday"), (3, "The cat-flap"), (4, "cat"), (5, "YES!"),
        (6, "(a)"), (7, "within the"), (8, "he is in -- the"), (9, "scat, cat"), (10, "cats cat's"), (11, "ca"),
        (12, "xabcdefghi"), (13, "x abcdefghi"), (14, "xabcdefghij"),
    ]
    want = {(3, 1), (4, 1), (5, 2), (6, 3), (8, 4), (9, 1), (10, 1), (13, 5), (13, 6), (12, 6), (14, 6)}
    frame = spark.createDataFrame([(*d, 1, 2) for d in docs], DOCS)
    bench = spark.createDataFrame([(*i, 9) for i in items], ITEMS)
    assert {(r.doc_id, r.item_id) for r in leaks(frame, bench).collect()} == want
    assert want == {(d, i) for d, i, _ in brute_force(docs, items, Search())}
    left = {r.doc_id for r in without_leaks(frame, bench).collect()}
    assert left == {d for d, _ in docs} - {d for d, _ in want}


def test_verbatim_search_of_long_items(spark):
    item = "one two three four five six seven"
    docs = spark.createDataFrame([(1, "x" + item[9:] + "x", 0, 0), (2, item[9:28], 0, 0), (3, "x" + item, 0, 0)], DOCS)
    found = leaks(docs, spark.createDataFrame([(1, item, 0)], ITEMS), Search(piece=20, stride=1, budget=0.0))
    assert {r.doc_id for r in found.collect()} == {1, 3}
