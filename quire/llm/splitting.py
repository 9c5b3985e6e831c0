"""Splitting oversized texts at natural boundaries.

A text of L chars gets n = ceil(L / S) pieces. The k-th cut is looked for in
the ``slack`` chars that end at k * L / n, where S = limit - overlap - slack +
1, so no cut depends on another and no piece, with its overlap, exceeds the
limit. Each cut takes the strongest boundary of its window, the last of equals.

Texts are worked on by ranges: each range counts its chars, prefix sums give
its place and the length of the whole, each range with a halo before it lists
the cuts whose targets it holds, the lists are stitched to one boundary table,
and pieces are emitted by offset. Rows of a table are cut into ranges of chars,
files into ranges of bytes that are read one by one; both give the same pieces.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.session import checkpoint_dir, cut_lineage

#: Chars of a range of a row, bytes of a range of a file.
RANGE_CHARS, RANGE_BYTES = 1 << 16, 8 << 20
#: Limits are a configuration of a row per strategy; more are refused, not cut.
MOST_STRATEGIES = 10_000
#: Boundaries from strong to weak, as patterns both engines read alike: paragraph,
#: end of sentence before a new line, end of sentence, end of line, clause, blank.
_PARAGRAPH = r"\n[ \t]*\r?\n\s*"
_SENTENCE_LINE = r"[.!?…。！？;:][\"'”»’)\]]*[ \t]*\r?\n"
_SENTENCE = r"(?:[.!?…][\"'”»’)\]]*\s+|[。！？][”」』）]*)"
_LINE = r"\n"
_CLAUSE = r"(?:[,;:|–—]\s+|[，；、])"
_BLANK = r"\s+"
PROSE = (_PARAGRAPH, _SENTENCE_LINE, _SENTENCE, _LINE, _CLAUSE, _BLANK)
ROWS = (_PARAGRAPH, _LINE, _SENTENCE, _CLAUSE, _BLANK)
#: Strategies whose lines are units of their own.
ROW_STRATEGIES = ("table_rows", "form_rows", "list_items", "presentation_slide")


def plan_columns(limit: Column, overlap: Column, share: float = 1 / 3) -> tuple[Column, Column, Column, Column]:
    """limit, overlap, slack, S; an overlap is held below half the limit, a limit is at least 1."""
    m = F.greatest(limit, F.lit(1))
    o = F.greatest(F.lit(0), F.least(overlap, F.floor((m - 1) / 2).cast("int")))
    s = F.greatest(F.lit(1), F.floor((m - o) * F.lit(share)).cast("int"))
    return m, o, s, m - o - s + 1


def plan(length: int, limit: int, overlap: int, share: float = 1 / 3) -> tuple[int, int, int]:
    """(pieces, slack, overlap) of a text of ``length`` chars; as plan_columns."""
    m = max(limit, 1)
    o = max(0, min(overlap, (m - 1) // 2))
    s = max(1, int((m - o) * share))
    return (1 if length <= m else -(-length // (m - o - s + 1))), s, o


def _last(window: Column, pattern: str) -> Column:
    return F.length(F.regexp_extract(window, rf"(?s)^(.*{pattern})", 1))


def cut_in_window(window: Column, rows: Column) -> Column:
    """Chars of the window before the cut, at least 1; without a boundary the whole window."""
    ladder = lambda patterns: [F.when(_last(window, p) > 0, _last(window, p)) for p in patterns]
    return F.coalesce(F.when(rows, F.coalesce(*ladder(ROWS))), F.when(~rows, F.coalesce(*ladder(PROSE))), F.length(window))


def cut_in_text(window: str, rows: bool) -> int:
    """As cut_in_window, for byte-range workers."""
    for p in ROWS if rows else PROSE:
        if m := re.match(rf"(?s)^(.*{p})", window):
            return len(m[1])
    return len(window)


def with_limits(chunks: DataFrame, limits: DataFrame, strategy: str = "chunk_strategy") -> DataFrame:
    """Chunks with max_chars and overlap_chars of their strategy; ``default`` serves null and unknown strategies.

    The limits have one row per strategy; of repeated rows the smallest limit
    holds. They become one literal map (a configuration, not data).
    """
    rows = limits.where(F.col("chunk_strategy").isNotNull() & F.col("max_chars").isNotNull()).groupBy("chunk_strategy").agg(F.min(F.struct("max_chars", "overlap_chars")).alias("l")).limit(MOST_STRATEGIES + 1).collect()
    if len(rows) > MOST_STRATEGIES:
        raise ValueError(f"more than {MOST_STRATEGIES} strategies with a limit")
    if not rows:
        raise ValueError("no limits given")
    by = {r["chunk_strategy"]: (r["l"]["max_chars"], r["l"]["overlap_chars"] or 0) for r in rows}
    default = by.get("default", min(by.values()))
    pick = lambda i: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for k, v in by.items() for x in (k, v[i])]), F.col(strategy)), F.lit(default[i]))
    return chunks.withColumn("max_chars", pick(0)).withColumn("overlap_chars", pick(1))


def text_ranges(texts: DataFrame, key: str) -> DataFrame:
    """Texts (key, text, _rows, _m, _o, _s, _step) by ranges: key, those settings, first, n, total, zero, buf.

    A range owns ``n`` chars from ``first``; ``buf`` begins at char ``zero``, as far before
    it as a window and an overlap reach. ``first`` and ``total`` are prefix sums of ``n``.
    """
    size = F.greatest(F.lit(RANGE_CHARS), F.col("_m"))
    r = texts.withColumn("_len", F.length("text")).withColumn("_size", size).withColumn("range_no", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("_len") / F.col("_size")) - 1, F.lit(0)).cast("int"))))
    begin = F.col("range_no") * F.col("_size")
    zero = F.greatest(begin - F.col("_m"), F.lit(0))
    r = r.withColumn("zero", zero).select(key, "_rows", "_m", "_o", "_s", "_step", "range_no", F.least(F.col("_size"), F.col("_len") - begin).alias("n"), "zero", F.substring(F.col("text"), F.col("zero") + 1, begin + F.col("_size") - F.col("zero")).alias("buf"))
    by = Window.partitionBy(key)
    return r.withColumn("first", F.sum("n").over(by.orderBy("range_no")) - F.col("n")).withColumn("total", F.sum("n").over(by)).drop("range_no")


def boundary_table(ranges: DataFrame, key: str) -> DataFrame:
    """key, piece_no, n_pieces, cut, start: where each piece begins, without and with its overlap, listed by the range that holds its target."""
    n = F.when(F.col("total") <= F.col("_m"), 1).otherwise(F.ceil(F.col("total") / F.col("_step"))).cast("long")
    r = ranges.withColumn("n_pieces", n)
    target = lambda k: F.ceil(k * F.col("total") / F.col("n_pieces")).cast("long")
    low = F.greatest(F.floor(F.col("first") * F.col("n_pieces") / F.greatest("total", F.lit(1))) - 1, F.lit(0))
    high = F.least(F.ceil((F.col("first") + F.col("n")) * F.col("n_pieces") / F.greatest("total", F.lit(1))) + 1, F.col("n_pieces") - 1)
    r = r.withColumn("piece_no", F.explode(F.sequence(low.cast("long"), F.greatest(high, low).cast("long")))).withColumn("t", target(F.col("piece_no")))
    r = r.where((F.col("piece_no") < F.col("n_pieces")) & (F.col("t") >= F.col("first")) & ((F.col("t") < F.col("first") + F.col("n")) | (F.col("total") == 0)))
    window = F.substring(F.col("buf"), (F.col("t") - F.col("_s") - F.col("zero") + 1).cast("int"), F.col("_s"))
    cut = F.when(F.col("piece_no") == 0, 0).otherwise(F.col("t") - F.col("_s") + cut_in_window(window, F.col("_rows"))).cast("int")
    b = r.select(key, F.col("piece_no").cast("int").alias("piece_no"), F.col("n_pieces").cast("int").alias("n_pieces"), "_o", cut.alias("cut"))
    return b.select(key, "piece_no", "n_pieces", "cut", F.when(F.col("piece_no") == 0, 0).otherwise(F.col("cut") - F.col("_o")).alias("start"))


def settled(chunks: DataFrame, limits: DataFrame, key: str, keep: tuple[str, ...]) -> DataFrame:
    """One row per key with a text: key, kept columns, text and the settings of its plan."""
    c = with_limits(chunks.where(F.col("text").isNotNull()), limits)
    m, o, s, step = plan_columns(F.col("max_chars"), F.col("overlap_chars"))
    return c.select(F.col(key), *keep, "text", F.coalesce(F.col("chunk_strategy").isin(*ROW_STRATEGIES), F.lit(False)).alias("_rows"), m.alias("_m"), o.alias("_o"), s.alias("_s"), step.alias("_step")).dropDuplicates([key])


def split_pieces(chunks: DataFrame, limits: DataFrame, key: str = "chunk_id", keep: tuple[str, ...] = ("section_id", "page_start")) -> DataFrame:
    """Pieces of every chunk: key, kept columns, piece_no, n_pieces, start, piece_chars, piece_text.

    Each piece but the first begins ``overlap`` chars before its cut. Null texts
    give no piece, an empty text one empty piece; chunks written twice give
    their pieces once. Texts are shuffled once, by key; ranges, sums, stitching
    and emission stay in that partitioning.
    """
    c = settled(chunks, limits, key, keep)
    b = boundary_table(text_ranges(c, key), key)
    end = F.lead("cut").over(Window.partitionBy(key).orderBy("piece_no"))  # a text's pieces are few
    p = b.withColumn("end", end).join(c.select(key, *keep, "text"), key)
    text = F.substring(F.col("text"), F.col("start") + 1, F.coalesce("end", F.length("text")) - F.col("start"))
    return p.select(key, *keep, "piece_no", "n_pieces", "start", text.alias("piece_text")).withColumn("piece_chars", F.length("piece_text"))


def oversized(chunks: DataFrame, limits: DataFrame, key: str = "chunk_id") -> DataFrame:
    """The keys that the splitter's boundary table cuts into more than one piece, once each."""
    return boundary_table(text_ranges(settled(chunks, limits, key, ()), key), key).where("n_pieces > 1").select(key).distinct()


# --- giant files, by byte ranges ---------------------------------------------


def _opened(uri: str):
    """(file system, path) of a URI or an absolute path, for any store that pyarrow reaches."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _read(uri: str, a: int, b: int) -> bytes:
    system, path = _opened(uri)
    with system.open_input_file(path) as f:
        return f.read_at(max(0, b - a), a)


def _chars(data: bytes) -> int:
    return len(data) - sum(map(data.count, _CONTINUED))


_CONTINUED = [bytes([x]) for x in range(0x80, 0xC0)]


def split_files(spark: SparkSession, files: list[tuple[str, int, int, bool]], range_bytes: int = RANGE_BYTES) -> DataFrame:
    """path, piece_no, n_pieces, start, piece_text of UTF-8 ``files`` (path or URI, limit, overlap, rows) that all executors reach.

    No task holds more than a range and its halo. Each range counts its chars;
    prefix sums place it; it lists its cuts with their chars and bytes; the
    lists are stitched by joining each cut to the next, and each piece is read
    by its bytes. A file that fits the limit is one piece; an empty file gives
    one empty piece.
    """
    rows = []
    for uri, limit, overlap, lines in files:
        system, path = _opened(uri)
        size = system.get_file_info(path).size
        rows += [(uri, limit, overlap, lines, i, a, min(a + range_bytes, size), size) for i, a in enumerate(range(0, max(size, 1), range_bytes))]
    columns = "path string, lim int, overlap int, by_rows boolean, range_no int, a long, b long, size long"
    ranges = spark.createDataFrame(rows, columns).repartition(max(1, len(rows)), "path", "range_no")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(n=[_chars(_read(p, a, b)) for p, a, b in zip(pdf["path"], pdf["a"], pdf["b"])])

    w = Window.partitionBy("path")  # a row per range of a file
    placed = cut_lineage(ranges.mapInPandas(count, columns + ", n long")).withColumn("first", F.sum("n").over(w.orderBy("range_no")) - F.col("n")).withColumn("total", F.sum("n").over(w))

    def cuts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                total, first = int(r.total), int(r.first)
                n, slack, over = plan(total, r.lim, r.overlap)
                at = max(0, int(r.a) - 4 * (slack + over))
                data = _read(r.path, at, int(r.b))
                skip = next((i for i in range(min(4, len(data))) if (data[i] & 0xC0) != 0x80), 0) if at else 0
                text = data[skip:].decode("utf-8", "ignore")
                zero = first - _chars(data[skip : int(r.a) - at])  # the file's char that text begins with
                place, byte = 0, at + skip  # chars and bytes passed so far

                def byte_of(char: int) -> int:
                    nonlocal place, byte
                    byte += len(text[place : char - zero].encode()) if char - zero >= place else -len(text[char - zero : place].encode())
                    place = char - zero
                    return byte

                k = max(0, first * n // max(1, total) - 1)
                while k < n:
                    t = -(-k * total // n)
                    if t >= first + r.n and not (k == 0 and first == 0):
                        break
                    if t >= first:
                        lo = t - slack - zero
                        cut = t - slack + cut_in_text(text[lo : lo + slack], r.by_rows) if k else 0
                        start = cut - over if k else 0
                        out.append((r.path, k, n, int(r.size), start, byte_of(start), byte_of(cut)))
                    k += 1
            yield pd.DataFrame(out, columns=["path", "piece_no", "n_pieces", "size", "start", "start_byte", "cut_byte"])

    table = cut_lineage(placed.mapInPandas(cuts, "path string, piece_no long, n_pieces long, size long, start long, start_byte long, cut_byte long"))
    after = table.select("path", (F.col("piece_no") - 1).alias("piece_no"), F.col("cut_byte").alias("end_byte"))
    pieces = table.join(after, ["path", "piece_no"], "left").withColumn("end_byte", F.coalesce("end_byte", "size")).repartitionByRange("path", "piece_no").sortWithinPartitions("path", "piece_no")

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = []
            for path, g in pdf.groupby("path", sort=False):
                lo, held = 0, b""
                for a, b in zip(g["start_byte"], g["end_byte"]):
                    if a < lo or b > lo + len(held):  # read on in steps of a range
                        lo, held = int(a), _read(path, int(a), max(int(b), min(int(a) + range_bytes, int(g["end_byte"].max()))))
                    texts.append(held[int(a) - lo : int(b) - lo].decode("utf-8", "replace"))
            yield pdf[["path", "piece_no", "n_pieces", "start"]].assign(piece_text=texts)

    return pieces.mapInPandas(emit, "path string, piece_no long, n_pieces long, start long, piece_text string")


def split_written(chunks: DataFrame, limits: DataFrame) -> DataFrame:
    """strategy, path, piece_no, n_pieces, start, piece_text: chunk texts written as files to the shared folder, a text a line, and split there.

    Shows the splitter of files on the texts of a table; the files are removed when the pieces are kept.
    """
    spark = chunks.sparkSession
    strategy = F.coalesce("chunk_strategy", F.lit("default"))
    texts = with_limits(chunks.where(F.col("text").isNotNull()).dropDuplicates(["chunk_id"]), limits).select(strategy.alias("strategy"), "text")
    folder = re.sub("^(?:file:)?/+", "file:///", checkpoint_dir(spark)) + f"/split-{uuid.uuid4().hex}"
    texts.write.partitionBy("strategy").text(folder)
    system, root = _opened(folder)
    from pyarrow import fs

    by = {r["strategy"]: (r["max_chars"], r["overlap_chars"]) for r in with_limits(texts.select("strategy").distinct(), limits, "strategy").collect()}
    at = [(x.path, re.search(r"strategy=([^/]+)/", x.path)[1]) for x in system.get_file_info(fs.FileSelector(root, recursive=True)) if x.is_file and x.path.endswith(".txt")]
    pieces = split_files(spark, [(folder + p[len(root) :], *by[s], s in ROW_STRATEGIES) for p, s in at])
    kept = cut_lineage(pieces.select(F.regexp_extract("path", "strategy=([^/]+)/", 1).alias("strategy"), "*"))
    system.delete_dir(root)
    return kept
