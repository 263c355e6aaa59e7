"""Operator 10, sharding: histogram sort into shards of near equal bytes.

Rows are ordered by (hash of the text, doc_id), so equal texts are neighbours. Exact byte and row counts of key cells are
taken over all partitions; cells that hold more than a tolerance are refined, round by round, each within its own least and
greatest hash or, if it holds one hash, doc_id, until the splitters meet the tolerance. Rows of one hash and doc_id (or none)
can't be told apart by their keys: too many of them are written once with a random place, which splits them. One exchange then
deals the rows out by cell, and a row's slot is its cell's offset plus its place in the cell. Only cells, at most a few
thousand a round, reach the driver.

Defined cases: a null text has size 1, the crc of the empty text and groups with other nulls; a null doc_id sorts first;
repeated rows keep a slot each; an empty table gives no rows. A group of equal texts stays in one shard unless that would
leave the tolerance; a group larger than a shard is split by doc_id, and rows of equal or null doc_ids anyhow. Extra columns pass through; those named
as one of the four that are added keep their values as input_size, input_text_crc32, input_shard or input_slot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import column, cut

CELL_BYTES = 1 << 28  # text of a usual cell, which is one sort group
MOST_BITS = 18  # so that a round's first cells have a bound
PART = 7  # digits of a path's part


def text_size(text: Column) -> Column:
    """UTF-8 bytes of the text, none for null, plus 1."""
    return (F.octet_length(F.coalesce(text, F.lit(""))) + F.lit(1)).cast("long")


def text_crc32(text: Column) -> Column:
    """Unsigned crc32 of the UTF-8 bytes; null counts as empty."""
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def _splitters(cells: list, shards: int, near: float) -> list[int]:
    """For each cell in key order its shard: boundaries at the cell edge nearest to each ideal byte count.

    An edge between two texts wins over one inside a group of equal texts if it is within near of the ideal."""
    total = sum(c["b"] for c in cells)
    edges, run = [], 0
    for c in cells:
        edges.append((run, c["fresh"]))
        run += c["b"]
    cuts = []
    for s in range(1, shards) if cells else ():
        ideal = total * s / shards
        best = min(range(len(edges)), key=lambda i: abs(edges[i][0] - ideal), default=0)
        whole = min((i for i in range(len(edges)) if edges[i][1]), key=lambda i: abs(edges[i][0] - ideal), default=best)
        at = whole if abs(edges[whole][0] - ideal) <= near else best
        cuts.append(max(at, cuts[-1] if cuts else 0))
    out, s = [], 0
    for i in range(len(cells)):
        while s < len(cuts) and i >= cuts[s]:
            s += 1
        out.append(s)
    return out


def _part(x: Column) -> Column:
    return F.lpad(x.cast("string"), PART, "0")


def _step(spark, cells: list, bits: int) -> DataFrame:
    """_c, _by_hash, _k and _from of cells to refine: a key's part is what its bits above the k-th are more than the cell's least."""
    rows = []
    for c in cells:
        by_hash = c["h0"] != c["h1"]
        low, high = (c["h0"], c["h1"]) if by_hash else (c["d0"], c["d1"])
        k = max(0, (high - low).bit_length() - bits)
        rows.append((c["c"], by_hash, k, low >> k))
    return F.broadcast(spark.createDataFrame(rows, "_c string, _by_hash boolean, _k int, _from long"))


def _refined(frame: DataFrame, step: DataFrame, how: str) -> DataFrame:
    """frame with _cell one part longer where the step refines it; a null doc_id has part 0."""
    key = F.when(F.col("_by_hash"), F.col("_h")).otherwise(F.col("doc_id").cast("long"))
    part = F.coalesce(F.call_function("shiftright", key, F.col("_k")) - F.col("_from") + 1, F.lit(0).cast("long"))
    deeper = F.when(F.col("_c").isNotNull(), F.concat("_cell", _part(part))).otherwise(F.col("_cell"))
    return frame.join(step, F.col("_cell") == F.col("_c"), how).withColumn("_cell", deeper).drop("_c", "_by_hash", "_k", "_from")


def _histogram(frame: DataFrame) -> list[dict]:
    d = F.col("doc_id").cast("long")
    got = frame.groupBy(F.col("_cell").alias("c")).agg(F.sum("size").alias("b"), F.count("*").alias("n"), F.min("_h").alias("h0"), F.max("_h").alias("h1"), F.min(d).alias("d0"), F.max(d).alias("d1"), F.count(d).alias("ids"))
    return [x.asDict() for x in got.collect()]


def histogram_sort(docs: DataFrame, shards: int = 8, tolerance: float = 0.002, near: float = 0.02) -> DataFrame:
    """docs with size, text_crc32, shard and slot. tolerance: of a shard's bytes, for a cell; near: of a shard's bytes, to keep a group whole."""
    if shards < 1:
        raise ValueError("shards must be positive")
    spark = docs.sparkSession
    own = [c for c in docs.columns if c not in ("doc_id", "text")]
    packed = docs.select(docs["doc_id"].alias("doc_id"), docs["text"].alias("text"), F.struct(*[column(docs, c) for c in own]).alias("_rest") if own else F.lit(None).alias("_rest"))
    text = F.coalesce(F.col("text"), F.lit(""))
    keys = packed.withColumns({"size": text_size(F.col("text")), "text_crc32": text_crc32(F.col("text")), "_h": F.xxhash64(text, F.col("text").isNull())})
    # The probes below read (doc_id, hash, size) alone, from a narrow written table rather than from the texts again.
    thin = cut(keys.select("doc_id", "_h", "size"), "keys")
    n, total = thin.agg(F.count("*"), F.sum("size")).first()
    cells: list = []
    equal: list = []  # cells too large whose rows have one hash and doc_id
    if n:
        bits = min(MOST_BITS, max(10, (total // CELL_BYTES).bit_length()))
        # A path names a cell; its parts have one width, so paths sort as their cells do.
        first = _part(F.shiftright("_h", 64 - bits) + ((1 << bits - 1) + 1))
        keys, thin = keys.withColumn("_cell", first), thin.withColumn("_cell", first)
        most = tolerance * total / shards
        cells = sorted(_histogram(thin), key=lambda x: x["c"])
        open_ = {c["c"] for c in cells}
        while True:
            # Refined are the cells that an ideal splitter falls into and those too large for one sort, 256 at most.
            run, big = 0, []
            for c in cells:
                inside = run * shards // total != (run + c["b"] - 1) * shards // total and c["b"] > most
                if c["c"] in open_ and c["n"] > 1 and (inside or c["b"] > max(total / 256, 4 * CELL_BYTES / (1 << 18))):
                    big.append(c)
                run += c["b"]
            same = [c for c in big if c["h0"] == c["h1"] and (not c["ids"] or c["ids"] == c["n"] and c["d0"] == c["d1"])]
            equal += same
            # What is refined has two keys at least, and a round tells its least and greatest apart: rounds end by themselves.
            names = {c["c"] for c in big} - {c["c"] for c in same}
            if not names:
                break
            step = _step(spark, [c for c in big if c["c"] in names], bits)
            got = _histogram(_refined(thin, step, "inner"))
            keys, thin = _refined(keys, step, "left"), _refined(thin, step, "left")
            cells = sorted([c for c in cells if c["c"] not in names] + got, key=lambda x: x["c"])
            open_ = {c["c"] for c in got}
    else:
        keys = keys.withColumn("_cell", F.lit("0"))
    if equal:
        names = {c["c"]: min(c["n"], 1 << bits, int(c["b"] / most) + 1) for c in equal}
        parts = F.broadcast(spark.createDataFrame(list(names.items()), "_c string, _parts long"))
        # Written, so that counting and dealing see the same places.
        placed = cut(keys.join(parts, F.col("_cell") == F.col("_c")).withColumn("_place", F.xxhash64(F.monotonically_increasing_id())).drop("_c"), "equal")
        placed = placed.withColumn("_cell", F.concat("_cell", _part(F.pmod("_place", "_parts")))).drop("_place", "_parts")
        cells = sorted([c for c in cells if c["c"] not in names] + _histogram(placed), key=lambda x: x["c"])
        keys = keys.join(parts, F.col("_cell") == F.col("_c"), "left_anti").unionByName(placed)
    for i, c in enumerate(cells):  # fresh: this cell begins with another text than the one before ends with
        c["fresh"] = not i or cells[i - 1]["h1"] != c["h0"]
    rows, offset = [], {}
    for c, s in zip(cells, _splitters(cells, shards, near * (sum(c["b"] for c in cells) / shards)), strict=True):
        rows.append((c["c"], s, offset.get(s, 0)))
        offset[s] = offset.get(s, 0) + c["n"]
    # The cells have a bound: 2**bits, and as many for each of the few refined in a round; rounds number 128 / bits at most.
    plan = F.broadcast(spark.createDataFrame(rows, "_cell string, shard int, _offset long"))
    dealt = keys.join(plan, "_cell")
    w = Window.partitionBy("_cell").orderBy("_h", F.col("doc_id").asc_nulls_first(), "size", "text_crc32")
    out = dealt.withColumn("slot", F.col("_offset") + F.row_number().over(w) - F.lit(1).cast("long"))
    added = ("size", "text_crc32", "shard", "slot")
    return out.select("doc_id", "text", *[F.col("_rest")[c].alias(f"input_{c}" if c in added else c) for c in own], *added)
