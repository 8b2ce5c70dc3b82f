from listwright.llm import lines

SCHEMA = "doc_id long, text string"
LONG = " ".join(f"w{i}" for i in range(55))


def texts(spark, rows, schema=SCHEMA):
    found = lines.deduplicated(spark.createDataFrame(rows, schema)).collect()
    return {r["doc_id"]: r["text"] for r in found}


def test_later_three_line_runs_go_and_neighbours_stay(spark):
    rows = [(1, "a\nb\nc\nd"), (2, "x\nb\nc\nd\ny"), (3, "b\nc\nz"), (4, "c\nd\nb")]
    assert texts(spark, rows) == {1: "a\nb\nc\nd", 2: "x\ny", 3: "b\nc\nz", 4: "c\nd\nb"}


def test_overlapping_windows_are_merged(spark):
    rows = [(1, "a\nb\nc\nd\ne"), (2, "a\nb\nc\nd\ne\nf")]
    assert texts(spark, rows) == {1: "a\nb\nc\nd\ne", 2: "f"}


def test_one_or_two_long_lines_are_windows(spark):
    half = " ".join(f"v{i}" for i in range(30))
    rows = [(1, f"one\n{LONG}\ntwo"), (2, f"three\n{LONG}\nfour"), (5, f"{half}\n{half}x"), (6, f"p\n{half}\n{half}x\nq"), (7, f"{half}\nr")]
    assert texts(spark, rows) == {1: f"one\n{LONG}\ntwo", 2: "three\nfour", 5: f"{half}\n{half}x", 6: "p\nq", 7: f"{half}\nr"}


def test_blank_lines_are_skipped_and_stay(spark):
    rows = [(1, "a\n\nb\nc"), (2, "a\nb\n \nc\n\n\n"), (3, "\n\n\n\n"), (4, "\n\n\n\n")]
    assert texts(spark, rows) == {1: "a\n\nb\nc", 2: " \n\n\n", 3: "\n\n\n\n", 4: "\n\n\n\n"}


def test_repeats_within_a_document(spark):
    assert texts(spark, [(1, "a\nb\nc\nx\na\nb\nc")]) == {1: "a\nb\nc\nx"}
    assert texts(spark, [(1, "a\na\na\na")]) == {1: "a"}


def test_nulls_copies_and_other_columns(spark):
    rows = [(None, "a\nb\nc", 5, 1), (2, "a\nb\nc", 5, 2), (3, None, None, 3), (4, "", 0, 4), (2, "a\nb\nc", 5, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, mark int")
    found = lines.deduplicated(docs)
    assert found.columns == docs.columns and found.dtypes == docs.dtypes
    assert {r["mark"]: (r["doc_id"], r["text"], r["n_chars"]) for r in found.collect()} == {
        1: (None, "a\nb\nc", 5), 2: (2, "", 0), 3: (3, None, None), 4: (4, "", 0), 5: (2, "", 0),
    }


def test_report_counts(spark):
    docs = spark.createDataFrame([(1, "a\nb\nc"), (2, "a\nb\nc\nd"), (3, None)], SCHEMA)
    assert sorted(map(tuple, lines.report(docs).collect())) == [(1, 3, 0, "a\nb\nc"), (2, 4, 3, "d"), (3, 0, 0, None)]


def test_very_long_text_and_empty_table(spark):
    long = "\n".join(f"line {i}" for i in range(20_000))
    found = texts(spark, [(1, long), (2, f"start\n{long}\nend")])
    assert found == {1: long, 2: "start\nend"}
    assert lines.deduplicated(spark.createDataFrame([], SCHEMA)).count() == 0
