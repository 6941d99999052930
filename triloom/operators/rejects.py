"""Loading of raw node lines: valid rows come out typed, the rest with the reason why they fail.

One pass without a shuffle. Each Arrow batch is checked for broken quoting with one linear regular expression; the rest
goes through pyarrow's CSV parser as strings, whose callback catches rows with a wrong number of columns; the columns
are then checked as vectors, and the first failing cell gives the reason.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triloom.functions.vocab import NODE_TYPES
from triloom.session import arrow, col

FIELDS = ["command", "key", "type", "code", "location", "function_id"]
_FIELD = r'(?:"(?:[^"]|"")*"|[^"\t][^\t]*)?'
QUOTING = rf"\A{_FIELD}(?:\t{_FIELD})*\z"
#: Cell checks, first failing one names the reason: field, pattern, whether the cell must match it.
CELLS = [
    ("key", r"\A[0-9]+\z", True),
    ("code", r"[\x{FFFD}\x00-\x08\x0a-\x1f\x7f]", False),
    ("location", r"\A(?:[0-9]+:[0-9]+:[0-9]+:[0-9]+)?\z", True),
    ("function_id", r"\A[0-9]*\z", True),
]


def check_node_lines(df: DataFrame, line_id: str = "line_id", path: str = "nodes_path", line_no: str = "line_no", line: str = "line") -> DataFrame:
    """One row for each line but the headers (``line_no`` 1): its six fields, or ``reason`` and the failing ``cell``.

    ``reason`` is null for a valid row, else ``null line``, ``quoting``, ``columns``, ``key``, ``type``, ``code``,
    ``location`` or ``function_id``. A line without a number counts as data. Repeated lines stay repeated. A null or
    empty line fails; lines of any length are taken whole. Other columns of ``df`` are not carried along.
    """
    lines = df.select(col(df, line_id).cast("long").alias("line_id"), col(df, path).alias("nodes_path"), col(df, line_no).cast("int").alias("line_no"), col(df, line).alias("line")).where(~F.col("line_no").eqNullSafe(1))
    schema = "line_id long, nodes_path string, line_no int, " + ", ".join(f"{f} string" for f in FIELDS) + ", n_columns int, reason string, cell string"
    return lines.transform(arrow, _check, schema)


def _check(batches):
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    kinds = pa.array(NODE_TYPES)
    for batch in batches:
        n = batch.num_rows
        raw = batch.column(batch.schema.get_field_index("line")).cast(pa.string())
        raw = pc.replace_substring_regex(raw, r"\r\z", "")
        reason = np.full(n, None, dtype=object)
        cell = np.full(n, None, dtype=object)
        width = np.zeros(n, dtype=np.int32)
        missing = np.asarray(pc.is_null(raw))
        quoted = np.asarray(pc.fill_null(pc.match_substring_regex(raw, QUOTING), False))
        reason[missing] = "null line"
        reason[~quoted & ~missing] = "quoting"
        cell[~quoted & ~missing] = raw.take(pa.array(np.flatnonzero(~quoted & ~missing))).to_numpy(zero_copy_only=False)
        at = np.flatnonzero(quoted)
        table, bad = _rows(pa, pc, pc.take(raw, pa.array(at)), at)
        for i, columns in bad:
            reason[i] = "columns"
            width[i] = columns
            cell[i] = raw[i].as_py()
        fields = {f: pa.nulls(n, pa.string()) for f in FIELDS}
        if table is not None and table.num_rows:
            rows = np.asarray(table.column("at").combine_chunks().cast(pa.int64()))
            width[rows] = len(FIELDS)
            checks = []
            for f, pattern, must in CELLS[:1] + [("type", None, True)] + CELLS[1:]:
                values = table.column(f).combine_chunks()
                hit = pc.is_in(values, value_set=kinds) if pattern is None else pc.match_substring_regex(values, pattern)
                checks.append((f, np.asarray(hit) != must, values))
            for f, fails, values in reversed(checks):  # the first failing check is written last
                where = np.flatnonzero(fails)
                reason[rows[where]] = f
                cell[rows[where]] = values.take(pa.array(where)).to_numpy(zero_copy_only=False)
            order = np.full(n, -1, dtype=np.int64)
            order[rows] = np.arange(len(rows))
            take = pa.array(order, mask=order < 0)
            fields = {f: table.column(f).combine_chunks().take(take) for f in FIELDS}
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(batch.schema.get_field_index(c)) for c in ("line_id", "nodes_path", "line_no")), *fields.values(), pa.array(width), pa.array(reason, pa.string()), pa.array(cell, pa.string())],
            ["line_id", "nodes_path", "line_no", *FIELDS, "n_columns", "reason", "cell"],
        )


def _rows(pa, pc, lines, at):
    """The parsed fields of lines with sound quoting, each with its place, and the (place, columns) of misshapen ones."""
    from pyarrow import csv

    if not len(lines):
        return None, []
    marks: list[tuple[str, str]] = []
    spare = (chr(c) for c in range(0xE000, 0xF8FF))
    for end in ("\r", "\n", "\0"):  # plain text inside a line, but the CSV parser would end or garble the row
        if pc.any(pc.match_substring(lines, end)).as_py():
            mark = next(c for c in spare if not pc.any(pc.match_substring(lines, c)).as_py())
            lines = pc.replace_substring(lines, end, mark)
            marks.append((mark, end))
    bad: list[tuple[int, int]] = []

    def skip(row):
        bad.append((int(row.text.split("\t", 1)[0]), row.actual_columns - 1))
        return "skip"

    whole = pc.binary_join_element_wise(pa.array(at.astype(str)), lines, "\t")
    names = ["at", *FIELDS]
    first = "\t".join(["0"] * len(names))  # a row that always fits: the parser refuses input without any
    data = (first + "\n").encode() + pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(whole)], pa.int32()), whole), "\n")[0].as_py().encode() + b"\n"
    table = csv.read_csv(
        pa.BufferReader(data),
        read_options=csv.ReadOptions(column_names=names, block_size=len(data) + 64, use_threads=False),
        parse_options=csv.ParseOptions(delimiter="\t", quote_char='"', double_quote=True, escape_char=False, newlines_in_values=True, ignore_empty_lines=False, invalid_row_handler=skip),
        convert_options=csv.ConvertOptions(column_types={c: pa.string() for c in names}, null_values=[], strings_can_be_null=False, quoted_strings_can_be_null=False, check_utf8=False),
    ).slice(1)
    for mark, end in marks:
        table = pa.table({c: pc.replace_substring(table.column(c), mark, end) for c in names})
    return table, bad


def valid_nodes(checked: DataFrame) -> DataFrame:
    """The valid rows, cast: node rows as the other operators take them, with the line they came from."""
    return checked.where("reason is null").select("line_id", "nodes_path", "line_no", "command", F.expr("try_cast(key as bigint)").alias("node_key"), "type", "code", "location", F.expr("try_cast(nullif(function_id, '') as bigint)").alias("function_id"))


def rejected(checked: DataFrame) -> DataFrame:
    return checked.where("reason is not null").select("line_id", "nodes_path", "line_no", "reason", "n_columns", "cell")
