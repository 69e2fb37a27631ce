import random

from labspark.llm.decontamination import Block, edit_distance_within, leaks
from labspark.llm.words import hashes_of, plain_words_of

WORDS = [a + b + c for a in "bdfgklmnprst" for b in "aeiou" for c in "lmnrst"]


def brute_within(item, text):
    """Edit distance between item and the nearest run of text."""
    before = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        now = [i]
        for j, b in enumerate(text, 1):
            now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (a != b)))
        before = now
    return min(before)


def edited(r, words, edits):
    words = list(words)
    for _ in range(edits):
        kind, at = r.randrange(3), r.randrange(len(words))
        if kind == 0:
            words[at] = r.choice(WORDS)
        elif kind == 1:
            del words[at]
        else:
            words.insert(at, r.choice(WORDS))
    return words


def test_distance_equals_dynamic_programming():
    r = random.Random(1)
    for _ in range(300):
        item, text = [r.randrange(4) for _ in range(r.randint(1, 9))], [r.randrange(4) for _ in range(r.randint(0, 15))]
        best, end = edit_distance_within(item, text)
        assert best == brute_within(item, text)
        assert brute_within(item, text[:end]) == best


def test_recall_at_the_largest_distance():
    r = random.Random(2)
    items = [r.choices(WORDS, k=r.randint(10, 60)) for _ in range(60)]
    block = Block([(i, [w.encode() for w in words]) for i, words in enumerate(items)])
    found = 0
    texts = []
    for k in range(600):
        item = items[k % 60]
        texts.append(r.choices(WORDS, k=r.randint(0, 80)) + edited(r, item, len(item) // 5) + r.choices(WORDS, k=r.randint(0, 80)))
    matches = {(row, item) for row, item, *_ in block.matches([hashes_of([w.encode() for w in t]) for t in texts])}
    found = sum((k, k % 60) in matches for k in range(600))
    assert found >= 0.99 * 600
    # Nothing beyond the distance is reported.
    assert all(brute_within(items[i], texts[k]) <= len(items[i]) // 5 for k, i in matches)


def test_query_equals_brute_force(spark, docs):
    r = random.Random(3)
    items = [(i, " ".join(r.choices(WORDS, k=r.randint(6, 40)))) for i in range(20)] + [(50, None), (51, ""), (52, "too short"), (53, None)]
    items.append((60, items[0][1].upper()))  # a repeated item in other letters
    rows = []
    for k in range(60):
        body = r.choices(WORDS, k=r.randint(0, 60))
        if k % 2:
            body[len(body) // 2 : len(body) // 2] = edited(r, items[k % 20][1].split(), k % 3)
        rows.append((k, " ".join(body).replace(" t", ", T")))
    rows += [(100, None), (101, ""), (None, items[3][1]), (3, rows[3][1]), (102, " ".join(WORDS * 300) + " " + items[1][1])]
    table = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, doc_id long")
    got = sorted(((x.doc_id, x.item_id, x.distance) for x in leaks(docs(rows), table).collect()), key=str)
    want = []
    for i, text in rows:
        for j, item in items:
            words = plain_words_of(item)
            if len(words) >= 5 and (d := brute_within(words, plain_words_of(text))) <= len(words) // 5:
                want.append((i, j, d))
    assert got == sorted(want, key=str) and len(want) > 30


def test_no_items_or_documents(spark, docs):
    items = spark.createDataFrame([(1, None)], "item_id long, text string")
    assert leaks(docs([(1, "a b c d e f")]), items).count() == 0
    items = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert leaks(docs([(1, "a")]).where("false"), items).count() == 0
