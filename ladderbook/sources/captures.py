"""Captured market data: tables' schemas, CSV readers and writers, symbol lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import written

MARKET = "recv_tsec bigint, recv_tnsec int, venue string, stream_kind string, shard_id int, conn_epoch bigint, conn_seq bigint, symbol string, payload_json string"
SNAPSHOTS = "recv_tsec bigint, recv_tnsec int, symbol string, lastUpdateId bigint, payload_json string"
SIDES = [f"{name}{i}" for name in ("bid", "bid_size", "ask", "ask_size") for i in range(5)]
BOOK = ["tsec", "tnsec", "seqNo", "id", "type", "side", *SIDES]
KEY = ["capture_id", "venue", "symbol"]
_CSV = {"header": "true", "quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad", "multiLine": "false", "enforceSchema": "true"}


def _read(spark: SparkSession, path, schema: str) -> DataFrame:
    """All fields as text first: junk in a number counts as 0, as it does for whom the files are meant."""
    fields = [f.strip().split(" ") for f in schema.split(",")]
    text = ", ".join(f"{n} string" for n, _ in fields)
    rows = spark.read.options(**_CSV).schema(f"{text}, _bad string").csv(path)
    clean = [F.coalesce(F.col(n).try_cast(t), F.lit(0).cast(t)).alias(n) if t != "string" else F.col(n) for n, t in fields]
    short = F.col(fields[-1][0]).isNull()  # longer rows are marked bad too, but their fields are all there
    return rows.select(*clean, _capture_of(F.col("_metadata.file_path")).alias("capture_id"), short.alias("bad"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"))


def _capture_of(path: Column) -> Column:
    """A file's name without .csv; of a folder that Spark has written, the folder's, be it parted by columns or not."""
    whole = F.regexp_replace(path, r"(/[^/=]+=[^/]*)*/part-[^/]*$", "")
    return F.regexp_replace(F.element_at(F.split(whole, "/"), -1), r"\.csv$", "")


def read_market(spark: SparkSession, path, capture_id: str | None = None, place: bool = False) -> DataFrame:
    """Captures with capture_id (as given, or by the file's or folder's name) and bad: rows of fewer than nine fields.

    With place, each row of a capture that is one file tells where it stands in it: (block, at), the first byte
    of the split that it was read in and a number that grows inside that. Places of a file compare like lines,
    however it was split; numbered_places() makes line numbers of them. In a folder of part files, which were
    written by many tasks, rows have no place.
    """
    rows = _read(spark, path, MARKET)
    if place:
        at = F.struct(F.col("_block").alias("block"), F.monotonically_increasing_id().alias("at"))
        rows = rows.withColumn("place", F.when(~F.element_at(F.split("_file", "/"), -1).startswith("part-"), at))
    rows = rows.drop("_file", "_block")
    return rows if capture_id is None else rows.withColumn("capture_id", F.lit(capture_id))


def numbered_places(market: DataFrame) -> DataFrame:
    """read_market(place=True) rows, written, with rn: 1, 2, … over the rows of each capture file; null without a place.

    Each split counts its rows; only the counts, one a split, are added up in order.
    """
    market = written(market, "market")
    counts = market.filter("place is not null").groupBy("capture_id", F.col("place.block").alias("_block")).agg(F.count("*").alias("_n"))
    before = Window.partitionBy("capture_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("capture_id").alias("_capture"), "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("capture_id", "place.block").orderBy("place.at"))
    joined = market.join(starts, (F.col("place.block") == F.col("_block")) & F.col("capture_id").eqNullSafe(F.col("_capture")), "left")
    return joined.select(*market.columns, F.when(F.col("place").isNotNull(), F.col("_start") + inside).alias("rn"))


def read_snapshots(spark: SparkSession, path, venue: str | None = None) -> DataFrame:
    """Sidecar rows of five fields with capture_id, that of the capture they belong to, snap_ord, their order in
    the file among those of the symbol, and venue, if given. Shorter rows are left out; broken_snapshots() has them."""
    rows = _read(spark, path, SNAPSHOTS).filter(~F.col("bad")).drop("bad")
    rows = rows.withColumns({"capture_id": F.regexp_replace("capture_id", "_snapshots$", ""), "_at": F.monotonically_increasing_id()})
    order = Window.partitionBy("capture_id", "symbol").orderBy("_file", "_block", "_at")  # a symbol's snapshots are few
    rows = rows.withColumn("snap_ord", F.row_number().over(order).cast("bigint")).drop("_file", "_block", "_at")
    return rows if venue is None else rows.withColumn("venue", F.lit(venue))


def broken_snapshots(spark: SparkSession, path) -> DataFrame:
    """Sidecar rows of fewer than five fields, with the reason."""
    return _read(spark, path, SNAPSHOTS).filter("bad").drop("bad", "_file", "_block").withColumn("reason", F.lit("short row"))


def sidecar_files(spark: SparkSession, path) -> DataFrame:
    """capture_id of each sidecar file, empty ones included."""
    files = spark.read.format("binaryFile").load(path).select(_capture_of(F.col("path")).alias("capture_id"))
    return files.distinct()


def sidecars(market: DataFrame, sidecar_ids: DataFrame) -> DataFrame:
    """capture_id, have_sidecar: whether a sidecar file is there, be it empty."""
    there = sidecar_ids.select(F.regexp_replace("capture_id", "_snapshots$", "").alias("capture_id")).distinct().withColumn("have_sidecar", F.lit(True))
    return market.select("capture_id").distinct().join(there, "capture_id", "left").fillna({"have_sidecar": False})


def write_market(market: DataFrame, path: str, form: str = "csv", replace: bool = False) -> None:
    """The nine columns by UTC date; with replace, the dates that market has take the place of what stood there for them."""
    names = [f.strip().split(" ")[0] for f in MARKET.split(",")]
    _write(market.select(*names, utc_date("recv_tsec").alias("date")), path, form, ["date"], replace)


def write_parsed(parsed: DataFrame, path: str, replace: bool = False) -> None:
    """parse_market() rows as a typed table by UTC date: ids and levels as columns, so that who reads it parses no JSON.

    The payload isn't kept; its hash is, by which rows that repeat a number are told apart.
    """
    names = [*KEY, *(f.strip().split(" ")[0] for f in MARKET.split(",") if f.split()[0] not in (*KEY, "payload_json"))]
    place = F.col("place") if "place" in parsed.columns else F.lit(None).cast("struct<block:bigint,at:bigint>")
    rows = parsed.select(*names, F.xxhash64("payload_json").alias("content"), "message", "valid", place.alias("place"), utc_date("recv_tsec").alias("date"))
    _write(rows, path, "parquet", ["date"], replace)


def read_parsed(spark: SparkSession, path: str) -> DataFrame:
    """What write_parsed() has written, for rebuild()."""
    return spark.read.parquet(path).drop("date")


def write_captures(market: DataFrame, path: str, order: list[str]) -> None:
    """One file path/X.csv for each capture_id X, its rows in order of `order`: what collectors leave and replays read.

    A capture is written by one task, as it is one file; captures are written at once.
    """
    names = [f.strip().split(" ")[0] for f in MARKET.split(",")]
    dealt = market.select("capture_id", *names, *[F.col(c).alias(f"_{k}") for k, c in enumerate(order)]).repartition("capture_id")
    dealt = dealt.sortWithinPartitions("capture_id", *[f"_{k}" for k in range(len(order))]).select("capture_id", *names)
    dealt.write.partitionBy("capture_id").options(header=True, quote='"', escape='"').csv(f"{path}/_parts")
    jvm, conf = market.sparkSession._jvm, market.sparkSession._jsc.hadoopConfiguration()
    top = jvm.org.apache.hadoop.fs.Path(path)
    files = top.getFileSystem(conf)
    for found in files.globStatus(jvm.org.apache.hadoop.fs.Path(f"{path}/_parts/capture_id=*/part-*")):  # names only, one a capture
        capture = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName(found.getPath().getParent().getName()[len("capture_id=") :])
        files.rename(found.getPath(), jvm.org.apache.hadoop.fs.Path(top, f"{capture}.csv"))


def write_snapshots(snapshots: DataFrame, path: str) -> None:
    """The five columns, in order of snap_ord if there is one."""
    if "snap_ord" in snapshots.columns:
        snapshots = snapshots.orderBy("snap_ord")
    snapshots.select(*[f.strip().split(" ")[0] for f in SNAPSHOTS.split(",")]).write.options(header=True, quote='"', escape='"').csv(path)


def write_book(book: DataFrame, path: str, form: str = "parquet", replace: bool = False) -> None:
    """The 26 columns by capture (if there is one), venue, UTC date and symbol, each in order of seqNo. With replace, what
    stood there for the same of these goes; all else stays."""
    missing = set(BOOK) - set(book.columns)
    if missing:
        raise ValueError(f"no book table: {sorted(missing)} missing")
    by = [*(c for c in ("capture_id",) if c in book.columns), "venue", "date", "symbol"]
    dated = book.withColumn("date", utc_date("tsec")).select(*BOOK, *by)
    dealt = dated.repartitionByRange(*by, "seqNo")  # one symbol's rows in several files, each a run of seqNo
    _write(dealt.sortWithinPartitions(*by, "seqNo"), path, form, by, replace)


def read_book(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    """A saved book: the 26 columns, and those by which it was parted, as texts. Raises ValueError where a file has other columns."""
    reader = spark.read.option("recursiveFileLookup", "false")
    if form == "csv":
        there = reader.options(header=True, quote='"', escape='"', inferSchema=False).csv(path)
    else:
        there = reader.parquet(path)
    parted = [c for c in there.columns if c not in BOOK]
    if [c for c in there.columns if c in BOOK] != BOOK or set(parted) - {"capture_id", "venue", "date", "symbol"}:
        raise ValueError(f"no book of {len(BOOK)} columns: {there.columns}")
    kinds = {"tnsec": "int", "id": "int", "type": "string", "side": "string"}
    return there.select(*[F.col(c).cast("string").alias(c) for c in parted], *[F.col(c).cast(kinds.get(c, "bigint")).alias(c) for c in BOOK])


def _write(df: DataFrame, path: str, form: str, by: list[str], replace: bool) -> None:
    out = df.write.partitionBy(*by).option("maxRecordsPerFile", 5_000_000)
    if replace:
        out = out.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    (out.options(header=True, quote='"', escape='"').csv(path) if form == "csv" else out.parquet(path))


def utc_date(sec: str) -> Column:
    """The UTC day of a second, as yyyyMMdd, in whatever time zone the session is."""
    return F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col(sec) / 86400).cast("int")), "yyyyMMdd")


def symbol_list(texts: DataFrame, column: str = "text", sep: str = ",") -> DataFrame:
    """(pos, symbol) of lists of symbols: no blanks, upper case, each at its first place; lines that start with # are none."""
    lines = texts.filter(~F.trim(F.col(column)).startswith("#"))
    each = lines.select(F.posexplode(F.split(column, sep)).alias("at", "s")).select("at", F.upper(F.trim("s")).alias("symbol")).filter("symbol <> ''")
    first = each.groupBy("symbol").agg(F.min("at").alias("at"))
    return first.select((F.row_number().over(Window.orderBy("at", "symbol")) - 1).alias("pos"), "symbol")  # as short as the list
