from weftline.operators import lineage as L
from weftline.sources import estate as E

SCHEMA = "path string, member string, language string, text string"


def lines_of(spark, main, **books):
    rows = [("/p/M.cbl", "M", "COBOL", main), *[(f"/p/{n}.cpy", n, "COPYBOOK", t) for n, t in books.items()]]
    return E.cobol_lines(spark.createDataFrame(rows, SCHEMA))


def code(lines):
    return [r.code.strip() for r in lines.orderBy("path", "line", "sub").collect()]


def test_replacing_of_words_pseudo_text_and_several_lines(spark):
    main = "           COPY B REPLACING ==:T:-A== BY\n               ==W$1==\n               OLD BY NEW\n               ==LONG  TEXT== BY ====.\n           MOVE OLD TO X.\n"
    book = "           MOVE :T:-A TO OLD.\n           MOVE OLD-2 TO LONG TEXT.\n           MOVE :T:-AB TO Y.\n"
    assert code(lines_of(spark, main, B=book)) == ["MOVE W$1 TO NEW.", "MOVE OLD-2 TO .", "MOVE :T:-AB TO Y.", "MOVE OLD TO X."]


def test_copy_without_period_takes_no_other_line(spark):
    assert code(lines_of(spark, "           COPY B\n           MOVE A TO C\n           MOVE D TO E.\n", B="           MOVE X TO Y.\n")) == ["MOVE X TO Y.", "MOVE A TO C", "MOVE D TO E."]


def test_books_in_cycles_and_twice(spark):
    lines = lines_of(spark, "           COPY A.\n           COPY A.\n           COPY C.\n", A="           COPY B.\n", B="           MOVE X TO Y.\n           COPY A.\n")
    assert code(lines) == ["MOVE X TO Y.", "COPY A."] * 2 + ["COPY C."]
    got = [(r.snippet, r.file, r.line) for r in E.copy_gaps(lines).collect()]
    assert sorted(got) == [("COPY A.: cycle", "/p/B.cpy", 2)] * 2 + [("COPY C.: missing", "/p/M.cbl", 3)]


def test_places_of_embedded_sql_and_of_statements_on_one_line(spark):
    main = "       PROCEDURE DIVISION.\n           MOVE A TO B. MOVE C TO D.\n\n           EXEC SQL\n             UPDATE T SET A = 1\n           END-EXEC.\n           MOVE 'x\n      -    'y' TO E.\n           MOVE F TO G.\n"
    lines = lines_of(spark, main)
    got = E.placed(E.statements(E.programs(lines)), E.line_starts(lines)).orderBy("seq").collect()
    assert [(r.verb, r.line) for r in got] == [("PROCEDURE", 1), ("MOVE", 2), ("MOVE", 2), ("EXEC", 4), ("MOVE", 7), ("MOVE", 9)]


def test_no_files(spark):
    none = spark.createDataFrame([], SCHEMA)
    lines = E.cobol_lines(none)
    assert E.placed(E.statements(E.programs(lines)), E.line_starts(lines)).count() == 0
    assert E.copy_gaps(lines).count() == 0 and E.placed(L.sql_statements(none), E.text_line_starts(none)).count() == 0


def test_gaps_of_an_estate_have_places(spark):
    """The places of all the gaps of the registered estates, by the text of the line they name."""
    from pyspark.sql import functions as F

    from weftline.plans import estate as P

    sf = "/root/testdata/sf0.001"
    text = P.files(spark, sf).select(F.col("path").alias("file"), F.posexplode(F.split("text", "\n")).alias("n", "raw")).withColumn("line", F.col("n") + 1)
    got = P.lineage(spark, sf).unparsed.where("program not like 'SORT.%'")
    assert got.where("line is null").count() == 0
    met = got.join(text, ["file", "line"]).select("statement_type", F.trim("raw").alias("raw"))
    begins = {"SQL_DML_UNMAPPED": "INSERT INTO T2", "JCL_PROC": "//", "JCL_TSO_RUN": "//", "COBOL_CALL": "CALL 'GONE", "COBOL_UNSTRING": "UNSTRING", "EXEC_SQL_UPDATE": "EXEC SQL UPDATE"}
    rows = met.collect()
    assert len(rows) == got.count() and {r.statement_type for r in rows} == set(begins)
    assert all(r.raw.startswith(begins[r.statement_type]) for r in rows), rows[:20]


def conditions(spark, text):
    rows = [("P", n, 0, x.split(" ")[0], x) for n, x in enumerate(text)]
    stmts = spark.createDataFrame(rows, "program string, seq int, sentence int, verb string, stmt string")
    return {(r.seq, r.target, r.source, r.logic) for r in L.conditional_sources(stmts, L.transforms(stmts)).collect()}


def test_search_without_key_adds_nothing(spark):
    assert conditions(spark, ["SEARCH TAB VARYING IX", "AT END", "MOVE 'N' TO R", "WHEN T-KEY (IX) = 'A'", "MOVE T-VAL (IX) TO R", "END-SEARCH"]) == set()


def test_end_of_a_file_in_a_found_branch_is_no_default(spark):
    got = conditions(spark, ["SEARCH TAB", "WHEN T-KEY (IX) = K", "READ F", "AT END", "MOVE 'N' TO R", "END-SEARCH"])
    assert got == {(4, "R", "K", "SEARCH TAB: lookup keyed on K")}


def test_search_in_a_search(spark):
    got = conditions(spark, ["SEARCH A", "AT END", "SEARCH B", "WHEN B-K (J) = Q", "MOVE B-V (J) TO R", "END-SEARCH", "WHEN A-K (I) = P", "MOVE A-V (I) TO R", "END-SEARCH"])
    assert got == {(4, "R", "Q", "SEARCH B: lookup keyed on Q"), (4, "R", "P", "SEARCH A: default keyed on P"), (7, "R", "P", "SEARCH A: lookup keyed on P")}
