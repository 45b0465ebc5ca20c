"""Statement files (S1-S8): numbered lines, one header per statement, one mapping per layout.

Reading: files are read as lines, so a file of any size is split over tasks (``maxPartitionBytes``).
A line knows its file, the start of its block in the file (``_metadata.file_block_start``) and its
place among the task's lines. One aggregate over all layouts counts the lines of every block and
keeps, of each block, the first line that looks like its layout's header; it has one row a block. A
prefix sum over a statement's blocks then gives every line its number, and the first header of the
statement the indexes of its columns. Both go back to the lines by (file, block), and one projection
turns the lines of all layouts into ledger rows: two scans, whatever the number of layouts.

A statement is a file, or a folder of Spark part files (``part-...``) read in name order, of which
only the first holds the header. Lines are split into cells by a quote-aware split (quotes and
doubled quotes honoured; one physical line = one record, D15).

Bad rows never abort the import (D9): they go to a quarantine frame ``(file, pos, line,
reason)``; ``strict=True`` turns them into a job failure with ``raise_error`` instead.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerspark.schema import MONEY

# ---- fixed values ----------------------------------------------------------------------
# Routing keys in configuration order; provider := the key found in the lowercase file name.
BANK_KEYS = ["amex", "canadiantire", "tdvisa", "hometrust", "wealthsimple"]
WS_RAW_NAME = r"(?i)^credit-card-statement-transactions-(\d{4})-(\d{2})-(\d{2})\.csv$"
WS_NORMALIZED_NAME = r"(?i)^ws-(\d{2})-(\d{4})\.csv$"
AMEX_PAYMENT = r"(?i)payment received"
CT_PAYMENT = "payment"
HOMETRUST_PAYMENTS = ["scotiabank payment", "payment"]
TDVISA_PAYMENT = "payment - thank you"
WS_PAYMENTS = ["payment", "payment settled", "payment received"]
# Date layouts tried for free-form statement dates (first match wins).
FREEFORM_DATES = ["yyyy-MM-dd", "M/d/yyyy", "yyyy/M/d", "d MMM yyyy", "MMM d, yyyy", "d-MMM-yyyy", "M/d/yy"]
# ---------------------------------------------------------------------------------------



@dataclass
class LoadResult:
    rows: DataFrame          # LEDGER columns + provider, file, pos (the line's number in its statement)
    quarantine: DataFrame    # file, pos, line, reason
    unknown_files: DataFrame | None = None


_NAME = r"([^/]+)$"
_PART = r"^(.*)/part-\d[^/]*$"


def read_lines(spark: SparkSession, path, file_filter=None) -> DataFrame:
    """(file, block, at, line) for every physical line of every file under ``path``. ``file_filter``
    maps the file-path Column to a predicate; Spark prunes files on it, so others are not read."""
    paths = path if isinstance(path, (list, tuple)) else [path]
    raw = spark.read.option("lineSep", "\n").text(list(paths))
    if file_filter is not None:
        raw = raw.filter(file_filter(F.col("_metadata.file_path")))
    return lines_of(raw.select(F.col("_metadata.file_path").alias("file"),
                               F.col("_metadata.file_block_start").alias("block"), "value"))


def lines_of(raw: DataFrame) -> DataFrame:
    """(file, block, value) rows in file order (a scan or a streaming micro-batch of one) -> lines.
    ``at`` grows along a block, which one task reads as a whole."""
    return raw.select("file", "block", F.monotonically_increasing_id().alias("at"),
                      F.regexp_replace("value", "\r$", "").alias("line"))


def read_grid(spark: SparkSession, path, file_filter=None) -> DataFrame:
    """The numbered lines that the layouts' loaders take; ``cells_of`` splits one into cells."""
    return read_lines(spark, path, file_filter)


# a comma followed by an even number of quotes up to the end of the line is a field separator;
# possessive quantifiers keep a malformed line (odd quote count) from backtracking
_CSV_SPLIT = r',(?=(?:[^"]*+"[^"]*+")*+[^"]*+$)'


def cells_of(line: str = "line") -> Column:
    """The cells of a line (SQL text): one quote-aware split, each field unquoted by a single
    ``transform`` over it; blank cells are NULL, and the number of cells tells a blank one from a
    missing one. (Layouts are written as SQL text: a plan of them takes a tenth of the calls.)"""
    return F.expr(_cells(line))


def _cells(line: str) -> str:
    inner = """CASE WHEN startswith(c, '"') AND endswith(c, '"') AND length(c) >= 2
                    THEN replace(substring(c, 2, length(c) - 2), '""', '"') ELSE c END"""
    return f"transform(split({line}, '{_CSV_SPLIT}', -1), c -> nullif({inner}, ''))"


def _cell(i: int) -> str:
    """The cell under the layout's column ``i`` (NULL where the header lacks it)."""
    return f"CASE WHEN try_element_at(idx, {i + 1}) > 0 THEN try_element_at(cells, try_element_at(idx, {i + 1})) END"


def _text(i: int) -> str:
    return f"trim(coalesce({_cell(i)}, ''))"


def _digits(i: int, keep: str) -> str:
    """The characters of a cell that make up its amount, NULL when there is none."""
    return f"nullif(regexp_replace(coalesce({_cell(i)}, ''), '[^{keep}]', ''), '')"


def _money(text: str) -> str:
    return f"try_cast(try_cast({text} AS DOUBLE) AS {MONEY.simpleString()})"


def _freeform(text: str) -> str:
    return "coalesce(" + ", ".join(f"try_to_date(trim({text}), '{p}')" for p in FREEFORM_DATES) + ")"


def _column_index(cells: str, name: str, trim: bool) -> str:
    """1-based index of the column named ``name`` (lowercase exact), else the first whose
    lowercase name contains it; 0 when none."""
    norm = f"transform({cells}, h -> lower({'trim(h)' if trim else 'h'}))"
    return (f"CAST(CASE WHEN array_position({norm}, '{name}') > 0 THEN array_position({norm}, '{name}') "
            f"ELSE array_position(transform({norm}, h -> coalesce(contains(h, '{name}'), false)), true) END AS INT)")


@dataclass(frozen=True)
class Layout:
    """How one bank's lines are read, as SQL text over ``line``, ``cells`` and ``idx`` (the header's
    1-based indexes of the layout's columns, 0: lacking). ``words`` are what a header line contains
    in lower case; only such lines are tested by ``header`` (cells -> whether it is one)."""

    parse: dict[str, str]    # date, description, merchant, amount[, skip]
    payment: str             # P11, over the parsed description
    words: tuple[str, ...] = ()
    header: Callable[[str], str] | None = None
    indexes: Callable[[str], list[str]] | None = None
    needed: int = 0          # the first so many indexes must be found
    first: bool = False      # the header is the statement's first line with text


def _exact_names(*names: str):
    return lambda cells: [f"CAST(array_position({cells}, '{n}') AS INT)" for n in names]


def _named_indexes(trim: bool):
    return lambda cells: [_column_index(cells, n, trim) for n in ("date", "description", "amount", "merchant")]


def _quoted(*texts: str) -> str:
    return ", ".join(f"'{t}'" for t in texts)


_MERCHANT_OR_DESCRIPTION = f"CASE WHEN try_element_at(idx, 4) > 0 THEN {_text(3)} ELSE {_text(1)} END"

# The first line whose cells (lowercase, untrimmed) include date, description and amount; blank
# amount -> row skipped; blank merchant -> description; payment = 'payment received' in the description
_AMEX = Layout(
    {"date": _freeform(_cell(0)), "description": _text(1),
     "merchant": f"coalesce(nullif({_MERCHANT_OR_DESCRIPTION}, ''), {_text(1)})",
     "amount": _money(_digits(2, "0-9.-")), "skip": f"{_digits(2, '0-9.-')} IS NULL"},
    f"description RLIKE '{AMEX_PAYMENT}'", ("date", "description", "amount"),
    lambda cells: " AND ".join(f"array_contains(transform({cells}, h -> lower(h)), '{n}')" for n in ("date", "description", "amount")),
    _named_indexes(False), 3)

# The first line where some trimmed lowercase cell contains date, some description and some
# amount (a preamble may precede it); blank amount -> error; payment = 'payment'
_CANADIANTIRE = Layout(
    {"date": _freeform(_cell(0)), "description": _text(1), "merchant": _MERCHANT_OR_DESCRIPTION,
     "amount": _money(_digits(2, "0-9.-"))},
    f"lower(description) = '{CT_PAYMENT}'", ("date", "description", "amount"),
    lambda cells: " AND ".join(f"exists({cells}, h -> coalesce(contains(lower(trim(h)), '{n}'), false))"
                               for n in ("date", "description", "amount")),
    _named_indexes(True), 3)

# S3: first line with case-sensitive Trans Date, Merchant Name, Amount; date M/d/yyyy; amount keeps
# digits and '.', '(...)' means negative (a plain minus is lost)
_HOMETRUST = Layout(
    {"date": f"try_to_date(trim({_cell(0)}), 'M/d/yyyy')", "description": _text(1), "merchant": _text(1),
     "amount": f"CASE WHEN contains({_text(2)}, '(') AND contains({_text(2)}, ')') THEN -{_money(_digits(2, '0-9.'))} "
               f"ELSE {_money(_digits(2, '0-9.'))} END"},
    f"lower(description) IN ({_quoted(*HOMETRUST_PAYMENTS)})", ("trans date", "merchant name", "amount"),
    lambda cells: "true", _exact_names("Trans Date", "Merchant Name", "Amount"), 3, True)


def _plain(i: int) -> str:
    return f"trim(coalesce(try_element_at(cells, {i + 1}), ''))"


# No header; lines with < 3 cells are skipped; c0 date M/d/yyyy, c1 description = merchant, c2
# amount; when c2 is blank and c3 is not, amount = -abs(c3)
_CREDIT = f"({_plain(2)} = '' AND size(cells) >= 4 AND {_plain(3)} <> '')"
_TD_CLEAN = "nullif(regexp_replace({0}, '[^0-9.-]', ''), '')"
_TDVISA = Layout(
    {"date": f"try_to_date({_plain(0)}, 'M/d/yyyy')", "description": _plain(1), "merchant": _plain(1),
     "amount": f"CASE WHEN {_CREDIT} THEN -abs({_money(_TD_CLEAN.format(_plain(3)))}) ELSE {_money(_TD_CLEAN.format(_plain(2)))} END",
     "skip": "size(cells) < 3"},
    f"lower(description) = '{TDVISA_PAYMENT}'")

# First line must contain transaction_date, type, details, amount (checked trimmed and lowercased,
# read by exact name); blank date or amount -> skipped; description = type or details, merchant =
# details or type; amount parsed as a plain number
_WS_NAMES = ("transaction_date", "type", "details", "amount")
_WEALTHSIMPLE = Layout(
    {"date": f"try_to_date({_text(1)}, 'yyyy-M-d')", "description": f"coalesce(nullif({_text(2)}, ''), {_text(3)})",
     "merchant": f"coalesce(nullif({_text(3)}, ''), {_text(2)})", "amount": _money(_text(4)),
     "skip": f"{_text(1)} = '' OR {_text(4)} = ''"},
    f"lower(description) IN ({_quoted(*WS_PAYMENTS)})", _WS_NAMES, lambda cells: "true",
    lambda cells: ["CASE WHEN " + " AND ".join(f"coalesce(array_contains(transform({cells}, h -> lower(trim(h))), '{n}'), false)"
                                               for n in _WS_NAMES) + " THEN 1 ELSE 0 END", *_exact_names(*_WS_NAMES)(cells)],
    1, True)

LAYOUTS: dict[str, Layout] = {"amex": _AMEX, "canadiantire": _CANADIANTIRE, "tdvisa": _TDVISA, "hometrust": _HOMETRUST,
                              "wealthsimple": _WEALTHSIMPLE}


def _by_bank(layouts: dict[str, Layout], of: Callable[[Layout], str]) -> Column:
    """``of(layout)`` (SQL text) for the line's layout; no CASE where there is only one."""
    if len(layouts) == 1:
        return F.expr(of(next(iter(layouts.values()))))
    return F.expr("CASE " + " ".join(f"WHEN bank = '{bank}' THEN {of(layout)}" for bank, layout in layouts.items()) + " END")


def block_table(lines: DataFrame, layouts: dict[str, Layout]) -> DataFrame:
    """One row per block: its first ``at`` and number of lines, the lines of its statement before it,
    and the statement's header line (``header_pos``, ``idx``). ``lines``: (bank, statement, file,
    block, at, line)."""
    has = lambda x: " AND ".join(f"contains(lower(line), '{w}')" for w in x.words)
    header = _by_bank(layouts, lambda x: f"CASE WHEN {has(x)} THEN CASE WHEN {x.header(_cells('line'))} THEN line END END"
                      if x.header else "CAST(NULL AS STRING)")
    # grouped by what a header-like line is, and by nothing for all others: plain counters per group
    counted = (lines.withColumn("header", header)
               .groupBy("bank", "statement", "file", "block", F.when(F.col("header").isNotNull(), F.col("at")).alias("header_at"), "header")
               .agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"),
                    F.min(F.when(F.col("line") != "", F.col("at"))).alias("text")))
    blocks = counted.groupBy("bank", "statement", "file", "block").agg(
        F.sum("n").alias("n"), F.min("first").alias("first"), F.min("text").alias("text"),
        F.min(F.when(F.col("header_at").isNotNull(), F.struct("header_at", "header"))).alias("h"))
    whole = Window.partitionBy("statement")
    before = F.coalesce(F.sum("n").over(whole.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.withColumn("before", before)
    place = lambda at: F.col("before") + at - F.col("first")
    blocks = (blocks.withColumn("text_pos", F.min(place(F.col("text"))).over(whole))
              .withColumn("h", F.min(F.when(F.col("h").isNotNull(), F.struct(place(F.col("h.header_at")).alias("pos"),
                                                                            F.col("h.header").alias("line")))).over(whole)))
    position = _by_bank(layouts, lambda x: "text_pos" if x.first else "h.pos")
    index = _by_bank(layouts, lambda x: f"array({', '.join(x.indexes('header_cells'))})" if x.indexes else "CAST(array() AS ARRAY<INT>)")
    return (blocks.withColumn("header_pos", position)
            .withColumn("header_cells", cells_of("CASE WHEN h.pos = header_pos THEN h.line END"))
            .select("file", "block", "first", "n", "before", "header_pos",
                    F.when(F.col("header_cells").isNotNull(), index).alias("idx")))


def _fault(layout: Layout) -> str:
    """Why no line of this line's statement can be read: its header is missing, or lacks a column."""
    if not layout.needed:
        return "CAST(NULL AS STRING)"
    lacks = " OR ".join(["idx IS NULL", *[f"coalesce(try_element_at(idx, {i + 1}), 0) = 0" for i in range(layout.needed)]])
    missing = f"CASE WHEN {lacks} THEN 'missing column' END"
    return missing if layout.first else f"CASE WHEN header_pos IS NULL THEN 'no header' ELSE {missing} END"


def _load(lines: DataFrame, layouts: dict[str, Layout], include_payments: bool, strict: bool) -> LoadResult:
    """All layouts' lines -> ledger rows and quarantine (one projection, P11, validation)."""
    blocks = block_table(lines, layouts)
    at = F.col("at") - F.col("first")
    # a block read by another task than when it was counted would get wrong numbers: fail instead
    pos = F.when((at >= 0) & (at < F.col("n")), F.col("before") + at).otherwise(
        F.raise_error(F.lit("a file changed while it was read")).cast("bigint"))
    body = (lines.join(blocks, ["file", "block"]).filter(F.col("line") != "")
            .select("bank", "file", pos.cast("int").alias("pos"), "line", cells_of().alias("cells"), "idx", "header_pos")
            .filter(F.col("header_pos").isNull() | (F.col("pos") > F.col("header_pos"))))
    def read_row(layout: Layout) -> str:
        fields = {**layout.parse, "__skip": layout.parse.get("skip", "false"), "__bad": _fault(layout)}
        fields.pop("skip", None)
        return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"

    # The generator keeps Catalyst from copying the parsing into every filter that reads its result.
    rows = body.select("bank", "file", "pos", "line", F.inline(F.array(_by_bank(layouts, read_row))))
    rows = rows.select("*", _by_bank(layouts, lambda x: x.payment).alias("__payment"))
    reason = (F.when(F.col("__bad").isNotNull(), F.col("__bad"))
              .when(F.col("date").isNull(), F.lit("unparsable date"))
              .when(F.col("amount").isNull(), F.lit("unparsable amount"))
              .when(F.lit(include_payments) & F.col("__payment") & (F.col("amount") >= 0), F.lit("payment not negative")))
    tagged = rows.filter(F.col("__bad").isNotNull() | ~F.coalesce("__skip", F.lit(False))).withColumn("__reason", reason)
    kept = F.lit(include_payments) | ~F.col("__payment")
    ledger = ["date", "description", "merchant", "amount", F.lit(None).cast("string").alias("category"),
              F.col("bank").alias("provider"), "file", "pos"]
    if strict:  # evaluating the check column over every row fails the job on the first bad row
        check = F.when(F.col("__reason").isNotNull(), F.raise_error(F.concat("bank", F.lit(": "), "__reason", F.lit(" in "), "file")))
        good = (tagged.withColumn("__check", check).filter(kept | F.col("__reason").isNotNull())
                .select(*ledger, "__check").filter(F.col("__check").isNull()).drop("__check"))
    else:
        good = tagged.filter(F.col("__reason").isNull() & kept).select(*ledger)
    return LoadResult(good, tagged.filter(F.col("__reason").isNotNull()).select(
        "file", "pos", "line", F.col("__reason").alias("reason")))


def load_layout(bank: str, grid: DataFrame, include_payments: bool = False, strict: bool = False) -> LoadResult:
    """Every file of ``grid`` (``read_grid``) as a statement of one bank."""
    lines = grid.withColumn("bank", F.lit(bank)).withColumn("statement", F.col("file"))
    return _load(lines, {bank: LAYOUTS[bank]}, include_payments, strict)


def load_amex(grid: DataFrame, include_payments: bool = False, strict: bool = False) -> LoadResult:
    return load_layout("amex", grid, include_payments, strict)


def load_canadiantire(grid: DataFrame, include_payments: bool = False, strict: bool = False) -> LoadResult:
    return load_layout("canadiantire", grid, include_payments, strict)


def load_hometrust(grid: DataFrame, include_payments: bool = False, strict: bool = False) -> LoadResult:
    return load_layout("hometrust", grid, include_payments, strict)


def load_tdvisa(grid: DataFrame, include_payments: bool = False, strict: bool = False) -> LoadResult:
    return load_layout("tdvisa", grid, include_payments, strict)


def load_wealthsimple(grid: DataFrame, include_payments: bool = False, strict: bool = False) -> LoadResult:
    return load_layout("wealthsimple", grid, include_payments, strict)


LOADERS = {
    "amex": load_amex,
    "canadiantire": load_canadiantire,
    "tdvisa": load_tdvisa,
    "hometrust": load_hometrust,
    "wealthsimple": load_wealthsimple,
}


def route(name: Column, bank_keys: list[str] | None = None) -> Column:
    """The first configured bank key contained in the lowercase name, else Wealthsimple by
    its file-name patterns (when configured), else NULL (unknown file)."""
    keys = bank_keys or BANK_KEYS
    low = F.lower(name)
    expr = None
    for k in keys:
        expr = F.when(low.contains(k.lower()), F.lit(k)) if expr is None else expr.when(low.contains(k.lower()), F.lit(k))
    if "wealthsimple" in keys:
        ws = name.rlike(WS_RAW_NAME) | name.rlike(WS_NORMALIZED_NAME)
        expr = expr.when(ws, F.lit("wealthsimple")) if expr is not None else F.when(ws, F.lit("wealthsimple"))
    return expr


def normalize_statement_name(name: Column) -> Column:
    """``credit-card-statement-transactions-YYYY-MM-DD.csv`` -> ``ws-MM-YYYY.csv``;
    ``ws-MM-YYYY.csv`` -> lowercased; anything else -> NULL (the caller reports it)."""
    raw = F.regexp_extract(name, WS_RAW_NAME, 0) != ""
    norm = F.regexp_extract(name, WS_NORMALIZED_NAME, 0) != ""
    return (F.when(norm, F.lower(name))
            .when(raw, F.concat(F.lit("ws-"), F.regexp_extract(name, WS_RAW_NAME, 2), F.lit("-"),
                                F.regexp_extract(name, WS_RAW_NAME, 1), F.lit(".csv"))))


def load_statements(spark: SparkSession, path, bank_keys: list[str] | None = None, include_payments: bool = False,
                    strict: bool = False, route_on: str = "name", grid: DataFrame | None = None) -> LoadResult:
    """Read every known file under ``path`` once, each line by its file's layout.

    ``route_on='path'`` routes on the whole path (useful for folders written by Spark, whose
    part-file names carry no bank name) and takes a folder of part files as one statement;
    ``'files'`` routes the same way but takes each file as a statement. ``grid`` lets a streaming
    micro-batch pass its own lines."""
    keys = bank_keys or BANK_KEYS
    layouts = {k: LAYOUTS[k] for k in keys if k in LAYOUTS}

    def routed(file: Column) -> Column:
        return route(F.regexp_extract(file, _NAME, 1) if route_on == "name" else file, keys)

    known = lambda file: F.coalesce(routed(file).isin(*layouts), F.lit(False))
    lines = read_lines(spark, path, known) if grid is None else grid.filter(known(F.col("file")))
    folder = F.regexp_extract("file", _PART, 1)
    statement = F.when(folder != "", folder).otherwise(F.col("file")) if route_on == "path" else F.col("file")
    res = _load(lines.withColumn("bank", routed(F.col("file"))).withColumn("statement", statement),
                layouts, include_payments, strict)
    if grid is None:  # the files' names alone: their content is not read
        files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"))
    else:
        files = grid.select("file")
    return LoadResult(res.rows, res.quarantine, files.filter(routed(F.col("file")).isNull()).distinct())
