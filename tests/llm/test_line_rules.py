from collections import Counter

from tessera.llm import line_rules

from .helpers import MESSY, empty, messy, rows_of, table


def brute(text):
    text = text or ""
    words = text.encode().split()
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    covered = {p for i, w in enumerate(windows) if often[w] > 1 for p in range(i, i + 5)}
    lines = [x for x in text.split("\n") if x.encode().split()]
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(len(w.decode()) for w in words), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), failed


NAMES = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_base_columns_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = sorted(((r.doc_id, *brute(r.text)) for r in docs.collect()), key=repr)
    assert rows_of(line_rules.judge(docs), *NAMES) == want


def test_messy_tables(spark):
    got = rows_of(line_rules.judge(messy(spark)), *NAMES)
    assert got == sorted(((r[0], *brute(r[1])) for r in MESSY), key=repr)
    assert all(not r.kept for r in line_rules.judge(messy(spark)).collect() if r.base_failed)
    assert line_rules.judge(empty(spark)).count() == 0


def test_lines_go_before_documents(spark):
    prose, second = "This is a plain sentence of ten words, it ends here.", "Another line goes on about other matters until it stops."
    cases = {
        1: prose,
        2: f"{prose}\nHome | News | Sport | Contact\n{second}",
        3: "Home | News | Sport | Contact\nAbout | Jobs | Press | Help | and so on\nok then",
        4: "\n".join(f"w{i}### of### it{i}$$$ all%%% so{i}&&&" for i in range(5)),
        5: "BUY!! NOW!! IT!! IS!! CHEAP!! AND!! GOOD!! FOR!! YOU!! ALL!! TODAY!! YES!!",
        6: f"{prose}\nPlease accept cookies to go on.\n{second}",
        7: " ".join(f"word{i}" for i in range(100)),
    }
    got = {r.doc_id: r for r in line_rules.judge(table(spark, list(cases.items()))).collect()}
    assert {i for i, r in got.items() if r.kept} == {1, 2, 6}
    assert got[1].clean_text == prose and got[2].clean_text == f"{prose}\n{second}" and "cookies" not in got[6].clean_text


def test_clean_documents_stay(spark):
    docs, marks = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = line_rules.judge(docs).join(marks, "doc_id").where("NOT base_failed").collect()
    good, bad = [r for r in rows if r.quality == 1], [r for r in rows if r.quality == 0]
    assert sum(r.kept for r in good) > 0.99 * len(good) and sum(r.kept for r in bad) < 0.05 * len(bad)


def test_query_equals_its_sql(spark, tmp_path):
    """Also on lines that each rule is about."""
    import duckdb

    from tessera.llm import queries

    prose = "This is a plain sentence of ten words, it ends here."
    odd = ["see https://a.b/c and https://d.e/f for more of this and that", "https://a.b/c here", "Start » News › Sport · Contact", "Alle Rechte vorbehalten", " ".join(f"w{i}" for i in range(25)), " ".join(f"w{i}" for i in range(25)) + ".  \r", "\x0b\t", "x", "", "a | b"]
    rows = [(i, "\n".join([prose, *odd[i % 10 : i % 10 + 1 + i // 10]])) for i in range(30)] + [(100, None), (101, "")]
    docs = table(spark, rows)
    docs.write.parquet(f"file://{tmp_path}/sf/documents.parquet")
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    for folder, files in ((f"file://{tmp_path}/sf", f"{tmp_path}/sf/documents.parquet/*.parquet"), ("/root/testdata/sf0.001", "/root/testdata/sf0.001/documents.parquet")):
        want = duckdb.sql(queries.SQL["op8_line_rules"].replace("FROM documents", f"FROM '{files}'")).fetchall()
        assert rows_of(queries.op8_line_rules(spark, folder), *names) == sorted(want, key=repr)
