"""Raw node lines: valid rows and rejects, against a plain parser."""

import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from triloom.functions.vocab import NODE_TYPES, VECTOR_DIMS
from triloom.operators.rejects import check_node_lines, rejected, valid_nodes

SCHEMA = "line_id long, nodes_path string, line_no int, line string"
GOOD = "ANR\t12\tSymbol\tx = 1\t1:2:3:4\t11"


def parse(line):
    """What the lines mean, read character by character; None where they don't parse."""
    line = line[:-1] if line.endswith("\r") else line
    fields, i = [], 0
    while True:
        if line[i : i + 1] == '"':
            out, i = "", i + 1
            while True:
                if i >= len(line):
                    return None
                if line[i] == '"':
                    if line[i + 1 : i + 2] == '"':
                        out, i = out + '"', i + 2
                        continue
                    i += 1
                    break
                out, i = out + line[i], i + 1
            if i < len(line) and line[i] != "\t":
                return None
        else:
            end = line.find("\t", i)
            end = len(line) if end < 0 else end
            out, i = line[i:end], end
        fields.append(out)
        if i >= len(line):
            return fields
        i += 1


def fails(line):
    f = None if line is None else parse(line)
    if f is None or len(f) != 6:
        return True
    digits = re.compile("[0-9]+")
    return not (digits.fullmatch(f[1]) and f[2] in NODE_TYPES and not re.search("[�\x00-\x08\x0a-\x1f\x7f]", f[3]) and re.fullmatch("([0-9]+:[0-9]+:[0-9]+:[0-9]+)?", f[4]) and re.fullmatch("[0-9]*", f[5]))


def checked(spark, lines, schema=SCHEMA):
    return check_node_lines(spark.createDataFrame([(i, "p", 2, x) for i, x in enumerate(lines)], schema))


def test_vocabulary():
    assert len(VECTOR_DIMS) == len(set(VECTOR_DIMS)) == 79 and len(NODE_TYPES) == 69


CASES = {
    GOOD: None, GOOD + "\r": None, GOOD + "\r\r": "function_id", "\t1\tSymbol\t\t\t": None, 'A\t1\tSymbol\t"a\tb ""q"""\t\t': None, 'a"b\t1\tSymbol\tx"y\t\t': None,
    "x\ry\x07\t1\tSymbol\t\t\t": None, "": "columns", "A": "columns", GOOD + "\t": "columns", None: "null line", 'A\t1\tSymbol\t"x\t\t': "quoting", 'A\t1\tSymbol\t"x"y\t\t': "quoting",
    "A\t\tSymbol\t\t\t": "key", "A\t-1\tSymbol\t\t\t": "key", "A\t١\tSymbol\t\t\t": "key", "A\t1\tsymbol\t\t\t": "type", "A\t1\tSymbol \t\t\t": "type", "A\t1\t\t\t\t": "type",
    "A\t1\tSymbol\tx�\t\t": "code", "A\t1\tSymbol\tx\x00\t\t": "code", "A\t1\tSymbol\tx\x7f\t\t": "code", "A\t1\tSymbol\tx\ny\t\t": "code", "A\t1\tSymbol\tx\ry\t\t": "code",
    "A\t1\tSymbol\t\t1:2:3\t": "location", "A\t1\tSymbol\t\t1:2:3:4:5\t": "location", "A\t1\tSymbol\t\t\tx": "function_id", "A\t1\tSymbol\t\t\t1 ": "function_id",
}


def test_each_reason(spark):
    got = {r.line_id: r.reason for r in checked(spark, list(CASES)).collect()}
    assert {x: got[i] for i, x in enumerate(CASES)} == CASES
    assert all(fails(x) == (why is not None) for x, why in CASES.items())


def test_fields_come_out_unquoted(spark):
    row = valid_nodes(checked(spark, ['A\t1\t"Symbol"\t"a\tb ""q"""\t1:2:3:4\t7\r'])).first()
    assert (row.node_key, row.type, row.code, row.location, row.function_id) == (1, "Symbol", 'a\tb "q"', "1:2:3:4", 7)


def test_headers_are_left_out_and_odd_numbers_are_data(spark):
    rows = [(1, "p", 1, "command\tkey"), (2, "p", None, GOOD), (3, None, 0, GOOD), (None, "p", 5, "bad")]
    out = check_node_lines(spark.createDataFrame(rows, SCHEMA))
    assert sorted((r.line_id or -1, r.reason) for r in out.collect()) == [(-1, "columns"), (2, None), (3, None)]


def test_whole_batches_without_a_valid_row_and_empty_tables(spark):
    assert rejected(checked(spark, ["x", "y", None])).count() == 3
    assert checked(spark, []).count() == 0
    assert checked(spark, [None]).count() == 1


def test_long_lines_repeats_and_clashing_columns(spark):
    long = "A\t1\tSymbol\t" + "y" * 3_000_000 + "\t\t"
    df = spark.createDataFrame([(1, "p", 2, long, "r"), (1, "p", 2, long, "r"), (2, "p", 2, long + "\t", "r")], SCHEMA + ", reason string")
    out = check_node_lines(df).collect()
    assert sorted((r.line_id, r.reason) for r in out) == [(1, None), (1, None), (2, "columns")] or sorted(((r.line_id, r.reason or "") for r in out)) == [(1, ""), (1, ""), (2, "columns")]
    assert max(len(r.code or "") for r in out) == 3_000_000


piece = st.sampled_from(["\t", '"', '""', "a", "1", "Symbol", "\r", "\n", "\x00", "�", ":", "1:2:3:4", "", "é", " "])


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.one_of(st.lists(piece, max_size=14).map("".join), st.tuples(*[st.lists(piece, max_size=3).map("".join)] * 4).map(lambda t: f"{t[0]}\t1\tSymbol\t{t[1]}\t{t[2]}\t{t[3]}")), min_size=1, max_size=60))
def test_like_the_plain_parser(spark, lines):
    got = {r.line_id: r.reason is not None for r in checked(spark, lines).collect()}
    assert got == {i: fails(x) for i, x in enumerate(lines)}
