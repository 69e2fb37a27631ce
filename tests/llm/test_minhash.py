import random

from labspark.llm import minhash
from labspark.llm.graph import components
from labspark.llm.minhash import near_duplicates
from labspark.llm.storage import written
from labspark.llm.words import words_of

WORDS = [f"{a}{b}{c}" for a in "bdfgklmnprst" for b in "aeiou" for c in "lmnrst"]


def brute(rows, percent=85, size=3):
    sets = {}
    for i, text in rows:
        w = words_of(text or "")
        sets[i] = frozenset(zip(*(w[k:] for k in range(size)), strict=False)) if len(w) >= size else frozenset([tuple(w)] if w else [])
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: (len(sets[i]), root(i)) for i in ids}


def corpus():
    random.seed(4)
    rows = []
    boilerplate = " ".join(random.choices(WORDS, k=40))
    for g in range(12):
        base = random.choices(WORDS, k=random.randint(1, 160))
        rows.append((len(rows) * 7, " ".join(base)))
        for c in range(random.randint(0, 25)):
            text = list(base)
            for _ in range(random.randint(0, 6)):
                text[random.randrange(len(text))] = random.choice(WORDS)
            rows.append((len(rows) * 7, " ".join(text)))
    for _ in range(60):  # documents that share only a passage
        rows.append((len(rows) * 7, boilerplate + " " + " ".join(random.choices(WORDS, k=random.randint(0, 60)))))
    rows += [(len(rows) * 7 + k, t) for k, t in enumerate([None, "", "  \n\t", "One", "one ", "One TWO", "one two", "ÄÖ x y", "äö x y", "a b c d e", "a b c d e"])]
    return rows


def test_equals_all_pairs(docs):
    rows = corpus()
    want = brute(rows)
    got = near_duplicates(docs(rows), shingle=3, percent=85).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_shingles, r.component_id) == want[r.doc_id], r
        assert r.kept == (r.doc_id == r.component_id)


def test_five_words_and_four_fifths(docs):
    rows = corpus()
    want = brute(rows, 80, 5)
    assert {r.doc_id: r.component_id for r in near_duplicates(docs(rows)).collect()} == {i: c for i, (_, c) in want.items()}


def test_long_texts_repeated_rows_and_null_ids(docs):
    long = " ".join(random.Random(1).choices(WORDS, k=60_000))
    rows = [(5, long), (9, long + " end"), (9, long + " end"), (None, "a b c d"), (3, "a b c d"), (4, "a b c d")]
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in near_duplicates(docs(rows)).collect()), key=str)
    assert got == sorted([(5, 5, True), (9, 5, False), (9, 5, False), (None, None, True), (3, 3, True), (4, 3, False)], key=str)


def test_empty_table(docs):
    assert near_duplicates(docs([(1, "x")]).where("false")).count() == 0


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 99), (99, 99), (None, 3), (7, 6)], "a long, b long")
    found = {r.node: r.component for r in components(edges).collect()}
    assert found == {i: 0 for i in range(61)} | {99: 99, 100: 99}


def test_only_texts_of_the_lists_are_read_again(docs, monkeypatch):
    tables = {}

    def kept(df, name):
        tables[name] = written(df, name)
        return tables[name]

    monkeypatch.setattr(minhash, "written", kept)
    rows = [(1, "a b c d e f g h"), (2, "a b c d e f g h i"), (3, "k l m n o p q r"), (4, None), (2, "another text of the same id")]
    near_duplicates(docs(rows), shingle=3, percent=85).collect()
    assert sorted(r.doc_id for r in tables["texts"].collect()) == [1, 2, 2]
