import duckdb

from labspark.llm.line_templates import ORACLE, _one_field, drop_recurring_lines

HEADER = "Generated by tool build {} for user someone in room {}"


def corpus():
    rows = []
    for i in range(12):
        lines = [f"Unique opening line of text number x{chr(97 + i)} and more", HEADER.format(100 + i, i)]
        lines.append(f"Visit our page for {['red', 'green', 'blue'][i % 3]} shoes and other useful things every day of the year")
        lines += ["   All   rights reserved  ", "", f"closing {chr(97 + i)}"] if i < 7 else ["Twice seen line"] if i < 9 else ["rare\tline 5"]
        rows.append((i, "\n".join(lines)))
    rows.append((20, "\n".join(["All rights reserved"] * 3)))
    rows.append((21, ""))
    rows.append((22, " \n\t"))
    rows.append((23, "\n".join(f"word{chr(97 + k % 26)}{chr(97 + k // 26 % 26)} tail text" for k in range(3000))))
    return rows


def test_equals_sql_on_strings(spark, docs):
    rows = corpus()
    got = sorted(tuple(r) for r in drop_recurring_lines(docs(rows)).select("doc_id", "n_lines", "n_dropped", "text").collect())
    con = duckdb.connect()
    con.execute("CREATE TABLE documents(doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert got == sorted(con.execute(ORACLE).fetchall())
    by_id = {r[0]: r for r in got}
    # The header's numbers and the shoes' colour are variable fields; the first line of a template stays.
    assert HEADER.format(100, 0) in by_id[0][3] and "room" not in by_id[5][3]
    assert "red shoes" in by_id[0][3] and "blue shoes" not in by_id[2][3]
    assert by_id[20][3] == "" and by_id[20][2] == 3
    assert "Twice seen line" in by_id[8][3] and "rare\tline 5" in by_id[9][3]


def test_nulls_repeated_rows_and_other_columns(spark, docs):
    rows = [(None, "same line here\nown a"), (1, None), (2, "same line here\nown b"), (2, "same line here\nown b")]
    rows += [(i, "same line here\nown c") for i in range(3, 6)]
    out = drop_recurring_lines(docs(rows))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "key", "signature", "value", "score", "n_lines", "n_dropped"]
    got = sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in out.collect()), key=str)
    want = [(None, "same line here\nown a", 2, 0), (1, None, 0, 0), (2, "own b", 2, 1), (2, "own b", 2, 1)]
    want += [(i, "own c", 2, 1) for i in (3, 4, 5)]
    assert got == sorted(want, key=str)
    assert drop_recurring_lines(docs(rows).where("false")).count() == 0


def test_templates_of_a_crowded_leaf(spark, docs):
    """Lines with one variable word go, however many other lines open alike; compared with plain Python."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    shoes = [f"Visit our page for {letters[i]}{letters[i + 1]} shoes and more" for i in range(20)]
    others = [f"Visit our page {' '.join(letters[(i * 7 + k * (i + 3)) % 26] * 3 + letters[i % 26] for k in range(5))}" for i in range(30)]
    other_fields = [f"Visit our page for blue {letters[i]}{letters[i]} and gone again" for i in range(4)]
    long = " ".join(f"w{letters[k % 26]}{letters[k // 26 % 26]}{letters[k // 676]}" for k in range(5000))
    lines = shoes + others + other_fields + [f"{long} end{letters[i]}" for i in range(5)]
    got = {r.doc_id: r.n_dropped for r in drop_recurring_lines(docs(list(enumerate(lines)))).collect()}
    alone = {r.doc_id: r.n_dropped for r in drop_recurring_lines(docs(list(enumerate(shoes)))).collect()}

    groups = {}
    for i, line in enumerate(lines):
        words = line.split()
        for at in range(3, len(words)):
            if len(words) < 100 or at == len(words) - 1:
                groups.setdefault((len(words), at, " ".join(words[:at] + words[at + 1 :])), set()).add(i)
    want = {i: 0 for i in range(len(lines))}
    for members in groups.values():
        if len(members) >= 5:
            want.update({i: 1 for i in members if i != min(members)})
    assert got == want and sum(want.values()) == 19 + 4
    assert alone == {i: int(i > 0) for i in range(20)}
    con = duckdb.connect()
    con.execute("CREATE TABLE documents(doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(lines)))
    assert {r[0]: r[2] for r in con.execute(ORACLE).fetchall()} == got


def test_one_field_reads_a_form_once(spark):
    """A row a form, and no join of its tokens with themselves."""
    texts = ["one two three four five", "one two three four six", "one two three other seven", "one two three four"]
    rows = [(1, i, 3, len(t.split()), t.split()) for i, t in enumerate(texts)]
    found = _one_field(spark.createDataFrame(rows, "leaf long, form long, docs long, n int, tokens array<string>"))
    groups = {r.form: r.group for r in found.collect()}
    assert set(groups) == {0, 1} and groups[0] == groups[1]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
