"""Files by adaptive partitions of time, and their rewriting when rows arrive.

*Leaves.* A layout's years, from its first moment to its last, are siblings. A node of more than L rows is split into all
its months, days or hours; siblings within L join the run of the sibling before while that stays within L. Leaves are
the runs with rows, hours of more than L rows, and one leaf of all rows without a moment.

*Boundaries.* A leaf of more than L rows is cut at every multiple of L of its order (moment, arrival, id, and, as the
ordinal of a tie, the row's number in the written table; nulls first). The key at each multiple is found by
distributed radix selection: a histogram of the next DIGIT bits over the rows that agree with a wanted key so far,
the digit in which the wanted rank falls, and so on until a bucket ends at that rank. There are at most as many wanted keys
as L goes into the table, so what the driver and the broadcasts hold does not grow with the rows. Rows find their part by a
search among their leaf's boundaries; none are ranked.

*Files.* Each part is sorted and written by one task as one file, into ``<file>=<number>`` below the folder; numbers are
never used twice. A rewriting compares parts by their rows (counts and sums of two hashes of whole rows): what recurs
under the same leaf and part keeps its file; the others are written first, and only then are the files that no longer
count deleted.

Nulls: rows without a time go to the leaf ``null``; rows without an arrival belong to the rewritten layout only; a
missing id sorts first, leaves the moment as it is, and is empty text in digests. Rows that are alike in every column are
rows of their own. An empty table makes no file. Any further columns are written as they are, whatever their names.
Years before 0 are written with a sign. The calendar is UTC's; a time with a zone counts as its local time in the session's zone.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxweave.llm.arrow import mapped
from voxweave.llm.tables import discard, saved, scratch

#: Bits of a key that a pass of the selection looks at.
DIGIT = 12
#: Rows of a table for each part of it.
SHARE = 650
HOUR, DAY = 3_600_000_000, 86_400_000_000
LEVELS = ("year", "month", "day", "hour")
#: The parts of a sort key, none negative: moment, arrival (upper and lower half), id, row number.
KEY = ("m", "ah", "al", "ch", "cl", "rh", "rl")


def free(name: str, columns: list[str]) -> str:
    """name, or name with underscores after it, so that it is none of the columns."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def micros(time: str) -> Column:
    """Microseconds from 1970 to a column of times without a zone."""
    return F.expr(f"(cast(`{time}` as timestamp_ntz) - TIMESTAMP_NTZ'1970-01-01 00:00:00') div INTERVAL '0.000001' SECOND")


def _below(x: Column, step: int) -> Column:
    return x - F.pmod(x, F.lit(step))


def levels(moment: Column) -> dict[str, Column]:
    """The number of the year, and of the month, day and hour since 1970, in which a moment lies."""
    day = (_below(moment, DAY) / F.lit(DAY)).cast("long")
    date = F.date_from_unix_date(day.cast("int"))
    return {"year": F.year(date).cast("long"), "month": ((F.year(date) - 1970) * 12 + F.month(date) - 1).cast("long"), "day": day, "hour": (_below(moment, HOUR) / F.lit(HOUR)).cast("long")}


@dataclass(frozen=True)
class Leaf:
    """A run of siblings: the name of its parents and its first and last member, and its members' numbers at its level (none: rows without a moment)."""

    name: str
    level: str
    members: range
    rows: int


def _children(level: str, parent: int) -> range:
    """The numbers of all months of a year, days of a month or hours of a day."""
    if level == "month":
        return range((parent - 1970) * 12, (parent - 1970) * 12 + 12)
    if level == "day":
        first, end = np.array([parent, parent + 1], "M8[M]").astype("M8[D]").astype("i8").tolist()
        return range(first, end)
    return range(parent * 24, parent * 24 + 24)


def _label(level: str, number: int) -> str:
    """What a member is called among its siblings."""
    if level == "year":
        return f"{number:04d}"
    if level == "month":
        return f"{number % 12 + 1:02d}"
    if level == "hour":
        return f"{number % 24:02d}"
    day = np.datetime64(number, "D")
    return f"{int((day - day.astype('M8[M]').astype('M8[D]')).astype('i8')) + 1:02d}"


def leaves(counts: dict[str, dict[int, int]], limit: int, nulls: int = 0) -> list[Leaf]:
    """The leaves with rows, by time, that of the rows without a moment last; counts: of each level, the rows of its numbers that are needed."""
    out: list[Leaf] = []

    def split(level: str, siblings: range, parents: str) -> None:
        run: list[int] | None = None  # first, last, rows
        done: list[list[int]] = []
        for k in siblings:
            n = counts[level].get(k, 0)
            if n > limit and level != "hour":
                done.append([k])
                run = None
            elif run is not None and run[2] + n <= limit:
                run[1], run[2] = k, run[2] + n
            else:
                run = [k, k, n]
                done.append(run)
        for found in done:
            if len(found) == 1:
                below = LEVELS[LEVELS.index(level) + 1]
                split(below, _children(below, found[0]), f"{parents}{_label(level, found[0])}/")
            elif found[2]:
                out.append(Leaf(f"{parents}{_label(level, found[0])}-{_label(level, found[1])}", level, range(found[0], found[1] + 1), found[2]))

    if years := [k for k, n in counts["year"].items() if n]:
        split("year", range(min(years), max(years) + 1), "")
    if nulls:
        out.append(Leaf("null", "", range(0), nulls))
    return out


class Layout:
    """Leaves for a limit of rows, with a number for each of their files, from a first one on."""

    def __init__(self, found: list[Leaf], limit: int, first: int):
        self.leaves, self.limit, self.number = found, limit, {}
        self.files: dict[int, tuple[str, int]] = {}
        for leaf in found:
            self.number[leaf.name] = first
            parts = -(-leaf.rows // limit)
            self.files |= {first + k: (leaf.name, k + 1) for k in range(parts)}
            first += parts
        self.end = first

    def targets(self) -> list[tuple[int, int]]:
        """The leaf's number and the rank of each boundary."""
        return [(self.number[leaf.name], rank) for leaf in self.leaves for rank in range(self.limit, leaf.rows, self.limit)]


def numbered(rows: DataFrame, moment: Column, arrival: str, identity: str, early: Column) -> tuple[DataFrame, dict[str, str]]:
    """rows, written to the shared folder with their moment (m, as microseconds), arrival (a), id (c, as text), whether they are early, and their number (r); and the names of these columns."""
    names = {k: free(f"_{k}", rows.columns) for k in ("m", "a", "early", "r")}
    out = rows.select("*", moment.cast("long").alias(names["m"]), micros(arrival).alias(names["a"]), F.coalesce(early, F.lit(False)).alias(names["early"]), F.monotonically_increasing_id().alias(names["r"]))
    return saved(out), names | {"c": identity}


def planned(rows: DataFrame, names: dict[str, str], limit: int) -> tuple[Layout, Layout]:
    """The layouts of the early rows and of all."""
    at = levels(F.col(names["m"]))
    both = [F.sum(F.col(names["early"]).cast("long")).alias("n0"), F.count(F.lit(1)).alias("n1")]
    hours = saved(rows.groupBy(*[c.alias(k) for k, c in at.items()]).agg(*both))
    nulls = hours.filter("hour is null").first()
    counts: list[dict[str, dict[int, int]]] = [{}, {}]
    over: list[int] | None = None
    for k, level in enumerate(LEVELS):
        some = hours.filter("hour is not null")
        if over is not None:
            some = some.filter(F.col(LEVELS[k - 1]).isin(over)) if over else some.limit(0)
        # of years as many as the calendar has, of others those below the nodes over the limit, which are few at any size
        got = some.groupBy(level).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).collect()
        for j in (0, 1):
            counts[j][level] = {r[level]: r[f"n{j}"] for r in got if r[f"n{j}"]}
        over = sorted({r[level] for r in got if r.n1 > limit})
    discard(hours)
    first = Layout(leaves(counts[0], limit, nulls.n0 if nulls else 0), limit, 0)
    return first, Layout(leaves(counts[1], limit, nulls.n1 if nulls else 0), limit, first.end)


def with_leaf(rows: DataFrame, layout: Layout, names: dict[str, str], to: str) -> DataFrame:
    """rows with the number of their leaf in the column to."""
    spark, found = rows.sparkSession, []
    at = levels(F.col(names["m"]))
    for level in LEVELS:
        members = [(k, layout.number[leaf.name]) for leaf in layout.leaves if leaf.level == level for k in leaf.members]
        if members:
            key, leaf = free(f"_{level}", rows.columns), free(f"_{level}_leaf", rows.columns)
            known = F.broadcast(spark.createDataFrame(members, f"{key} long, {leaf} int"))
            rows = rows.join(known, at[level] == F.col(key), "left").drop(key)
            found.append(leaf)
    null = F.when(F.col(names["m"]).isNull(), F.lit(layout.number.get("null")).cast("int"))
    return rows.withColumn(to, F.coalesce(null, *[F.col(c) for c in found])).drop(*found)


def key_parts(names: dict[str, str], identity: Column) -> dict[str, Column]:
    """KEY as longs, each in the order of what it is of; nulls are the least."""
    a, r = F.col(names["a"]), F.col(names["r"])
    upper = lambda x: F.coalesce(F.shiftright(x, 32), F.lit(-(1 << 33)))
    lower = lambda x: F.coalesce(x.bitwiseAND(F.lit(0xFFFFFFFF)), F.lit(0).cast("long"))
    return {"m": F.coalesce(F.pmod(F.col(names["m"]), F.lit(HOUR)), F.lit(0).cast("long")), "ah": upper(a), "al": lower(a), "ch": upper(identity), "cl": lower(identity), "rh": F.shiftright(r, 32), "rl": lower(r)}


def selected(keys: DataFrame, targets: list[tuple[int, int]]) -> dict[int, list[tuple[int, ...]]]:
    """For each leaf and rank of targets a key (KEY) that just that many rows of the leaf do not exceed, by radix selection.

    keys: leaf, and KEY of the rows of the leaves that have targets. The keys of a leaf are in the order of their ranks.
    """
    spark = keys.sparkSession
    low = keys.agg(*[F.min(c).alias(c) for c in KEY], *[F.max(c).alias(f"{c}_") for c in KEY]).first()
    base = {c: low[c] for c in KEY}
    bits = {c: (low[f"{c}_"] - low[c]).bit_length() for c in KEY}
    rows = saved(keys.select("leaf", *[(F.col(c) - F.lit(base[c])).alias(c) for c in KEY]))
    # a wanted key: leaf, rank in its cell, and the cell: the digits that its rows agree in, as (column, value)
    open_cells: dict[tuple, list[tuple[int, int]]] = defaultdict(list)
    for leaf, rank in targets:
        open_cells[leaf, ()].append((rank, rank))
    out: dict[int, list[tuple[int, tuple[int, ...]]]] = defaultdict(list)

    def bound(leaf: int, rank: int, prefix: tuple[int, ...], column: int, shift: int, value: int) -> None:
        whole = [*prefix[:column], (value << shift) | ((1 << shift) - 1), *[(1 << 62)] * (len(KEY) - column - 1)]
        out[leaf].append((rank, tuple(x + base[c] if x < 1 << 62 else x for x, c in zip(whole, KEY))))

    for column, name in enumerate(KEY):
        shift = bits[name]
        begun = False
        while (shift or (name == KEY[-1] and not begun)) and open_cells:
            width = min(DIGIT, shift)
            above, shift, begun = shift, shift - width, True
            # the cells, by what their rows agree in: whole columns, and the upper bits of this one
            cells = list(open_cells)
            fields = ["leaf", *KEY[:column], "_upper"]
            table = [(k, leaf, *prefix[:column], prefix[column] if len(prefix) > column else 0) for k, (leaf, prefix) in enumerate(cells)]
            some = F.broadcast(spark.createDataFrame(table, "_cell int, " + ", ".join(f"{f} long" for f in fields)))
            digit = F.shiftright(F.col(name), shift).bitwiseAND(F.lit((1 << width) - 1)).alias("digit")
            mine = rows.withColumn("_upper", F.shiftright(F.col(name), above) if above < 63 else F.lit(0).cast("long")).join(some, fields)
            histogram = mine.groupBy("_cell", digit).agg(F.count(F.lit(1)).alias("n"))
            # for each rank the digit in which it falls, how many rows lie below that, and how many in it
            lists = histogram.groupBy("_cell").agg(F.sort_array(F.collect_list(F.struct("digit", "n"))).alias("bars"))
            ranks = F.broadcast(spark.createDataFrame([(k, leaf_rank, rank) for k, c in enumerate(cells) for leaf_rank, rank in open_cells[c]], "_cell int, leaf_rank long, rank long"))
            start = F.struct(F.lit(0).cast("long").alias("below"), F.lit(None).cast("long").alias("digit"), F.lit(0).cast("long").alias("n"))
            step = lambda acc, x: F.when(acc.n > 0, acc).when(acc.below + x.n >= F.col("rank"), F.struct(acc.below.alias("below"), x.digit.alias("digit"), x.n.alias("n"))).otherwise(F.struct((acc.below + x.n).alias("below"), acc.digit.alias("digit"), acc.n.alias("n")))
            found = lists.join(ranks, "_cell").select("_cell", "leaf_rank", "rank", F.aggregate("bars", start, step).alias("at")).collect()
            after: dict[tuple, list[tuple[int, int]]] = defaultdict(list)
            for r in found:
                leaf, prefix = cells[r["_cell"]]
                value = ((prefix[column] if len(prefix) > column else 0) << width) | r["at"].digit
                rest = r["rank"] - r["at"].below
                if rest == r["at"].n:
                    bound(leaf, r.leaf_rank, prefix, column, shift, value)
                else:
                    after[leaf, (*prefix[:column], value)].append((r.leaf_rank, rest))
            open_cells = after
        if not begun:  # all rows have the same value here
            open_cells = {(leaf, (*prefix, 0)): v for (leaf, prefix), v in open_cells.items()}
    discard(rows)
    return {leaf: [key for _, key in sorted(found)] for leaf, found in out.items()}


def boundaries(rows: DataFrame, names: dict[str, str], identity: Column, layouts: tuple[Layout, Layout]) -> dict[int, list[tuple[int, ...]]]:
    """The greatest key of each part but the last, by the leaf's number, of the leaves that have several; the first layout is of the early rows."""
    targets = [t for layout in layouts for t in layout.targets()]
    if not targets:
        return {}
    several = sorted({leaf for leaf, _ in targets})
    first, last = free("_leaf0", rows.columns), free("_leaf1", rows.columns)
    rows = with_leaf(with_leaf(rows, layouts[0], names, first), layouts[1], names, last)
    here = [F.when(F.col(names["early"]), F.col(first)), F.col(last)]
    wide = rows.select(F.explode(F.array_compact(F.array(*here))).alias("leaf"), *[c.alias(k) for k, c in key_parts(names, identity).items()])
    return selected(wide.filter(F.col("leaf").isin(several)), targets)


def _passed(bounds: Column, key: Column, most: int) -> Column:
    """How many of the bounds, ascending and ``most`` at most, lie below the key."""
    steps = F.array(*[F.lit(1 << k) for k in range(most.bit_length() - 1, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.coalesce(F.get(bounds, at + step - 1) < key, F.lit(False)), at + step).otherwise(at))


def with_file(rows: DataFrame, layout: Layout, names: dict[str, str], identity: Column, bounds: dict[int, list[tuple[int, ...]]], to: str) -> DataFrame:
    """rows with the number of their file in the layout, in the column to."""
    spark = rows.sparkSession
    out = with_leaf(rows, layout, names, to)
    mine = [(leaf, [tuple(b) for b in bounds[leaf]]) for leaf in layout.number.values() if leaf in bounds]
    if not mine:
        return out
    leaf, lists = free("_of", out.columns), free("_bounds", out.columns)
    known = F.broadcast(spark.createDataFrame(mine, f"{leaf} int, {lists} array<struct<{', '.join(f'{c}: bigint' for c in KEY)}>>"))
    key = F.struct(*[c.alias(k) for k, c in key_parts(names, identity).items()])
    out = out.join(known, F.col(to) == F.col(leaf), "left")
    part = F.when(F.col(lists).isNotNull(), _passed(F.col(lists), key, max(len(b) for _, b in mine))).otherwise(F.lit(0))
    return out.withColumn(to, F.col(to) + part).drop(leaf, lists)


def write(rows: DataFrame, columns: list[str], names: dict[str, str], file: str, folder: str, files: int) -> None:
    """Writes rows by the number in the column file, each number's as one file in the order of their keys, by one task that streams them."""
    tasks = max(1, min(files, 4 * rows.sparkSession.sparkContext.defaultParallelism))
    dealt = rows.repartitionById(tasks, F.pmod(F.col(file), F.lit(tasks)).cast("int"))
    dealt.sortWithinPartitions(file, names["m"], names["a"], names["c"], names["r"]).select(*columns, file).write.mode("append").partitionBy(file).parquet(folder)


def digests(rows: DataFrame, columns: list[str], files: list[Column]) -> dict[int, tuple]:
    """Of each file's number, how many rows it has and two sums of hashes of them; as many as there are files."""
    value = [F.xxhash64(*[F.col(f"`{c}`") for c in columns]), F.xxhash64(F.lit(1), *[F.col(f"`{c}`") for c in columns])]
    each = rows.select(F.explode(F.array_compact(F.array(*files))).alias("f"), value[0].alias("x"), value[1].alias("y"))
    found = each.groupBy("f").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(c).cast("decimal(20,0)")).alias(c) for c in ("x", "y")]).collect()
    return {r.f: (r.n, r.x, r.y) for r in found}


def listed(spark: SparkSession, folder: str) -> dict[int, list[str]]:
    """The data files below a folder by their numbers."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    out: dict[int, list[str]] = defaultdict(list)
    for d in fs.listStatus(at) if fs.exists(at) else []:
        name = d.getPath().getName()
        if d.isDirectory() and "=" in name:
            for f in fs.listStatus(d.getPath()):
                if not f.getPath().getName().startswith((".", "_")):
                    out[int(name.rsplit("=", 1)[1])].append(f"{folder}/{name}/{f.getPath().getName()}")
    return out


def drop_files(spark: SparkSession, folder: str, file: str, numbers: list[int]) -> None:
    fs = spark._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    for k in numbers:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{file}={k}"), True)


def read_back(spark: SparkSession, folder: str, identity: str, new: Column, tasks: int) -> tuple[DataFrame, list[str]]:
    """file, n_rows, n_new, ids_sha256 of each file below the folder, from the files, row by row in their order; and the columns they have."""
    rows = spark.read.option("recursiveFileLookup", "true").parquet(folder)
    number = F.regexp_extract(F.col("_metadata.file_path"), r"=(\d+)/[^/]*$", 1).cast("int")
    ids = rows.select(number.alias("file"), F.col("_metadata.row_index").alias("at"), F.coalesce(F.col(identity).cast("string"), F.lit("")).alias("id"), F.coalesce(new, F.lit(True)).alias("new"))
    dealt = ids.repartitionById(tasks, F.pmod(F.col("file"), F.lit(tasks)).cast("int")).sortWithinPartitions("file", "at").select("file", "id", "new")

    def summed(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        now, sha, n, fresh = None, None, 0, 0
        done: list[tuple] = []
        for batch in batches:
            file = batch.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(file)) + 1).tolist(), len(file)]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                if file[a] != now:
                    if now is not None:
                        done.append((now, n, fresh, sha.hexdigest()))
                    now, sha, n, fresh = file[a], hashlib.sha256(), 0, 0
                text = ",".join(batch.column(1).slice(a, b - a).to_pylist())
                sha.update(((",") * (n > 0) + text).encode())
                n += b - a
                fresh += pc.sum(batch.column(2).slice(a, b - a)).as_py()
        if now is not None:
            done.append((now, n, fresh, sha.hexdigest()))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([int(d[k]) if k < 3 else d[k] for d in done], t) for k, t in enumerate([pa.int32(), pa.int64(), pa.int64(), pa.string()])], names=["file", "n_rows", "n_new", "ids_sha256"])

    return mapped(dealt, summed, "file int, n_rows long, n_new long, ids_sha256 string"), rows.columns


RESULT = "leaf string, part long, n_rows long, n_new long, rewritten boolean, columns string, ids_sha256 string, path string"


def laid_out(rows: DataFrame, moment: Column, arrival: str, identity: str, before: str, folder: str, share: int = SHARE) -> DataFrame:
    """Writes the rows that arrived before a time, then rewrites the folder for all rows; RESULT of each file that is there at the end.

    identity: a column of whole numbers.
    """
    spark, columns = rows.sparkSession, rows.columns
    early = F.expr(f"cast(`{arrival}` as timestamp_ntz) < TIMESTAMP_NTZ'{before}'")
    base, names = numbered(rows, moment, arrival, identity, early)
    n = base.count()
    limit = 1 + n // share
    layouts = planned(base, names, limit)
    number = F.col(f"`{identity}`").cast("long")
    bounds = boundaries(base, names, number, layouts)
    f0, f1, file = free("_f0", base.columns), free("_f1", base.columns), free("file", columns)
    starting = with_file(base.filter(F.col(names["early"])), layouts[0], names, number, bounds, file)
    if layouts[0].files:
        write(starting, columns, names, file, folder, len(layouts[0].files))
    both = with_file(with_file(base, layouts[0], names, number, bounds, f0), layouts[1], names, number, bounds, f1)
    known = digests(both, columns, [F.when(F.col(names["early"]), F.col(f0)), F.col(f1)])
    had = {place: k for k, place in layouts[0].files.items()}
    stays = {k: had[place] for k, place in layouts[1].files.items() if place in had and known[had[place]] == known[k]}
    fresh = sorted(set(layouts[1].files) - set(stays))
    if fresh:
        wanted = F.broadcast(spark.createDataFrame([(k,) for k in fresh], f"`{file}` int"))
        whole = with_file(base, layouts[1], names, number, bounds, file)
        write(whole.join(wanted, file, "left_semi"), columns, names, file, folder, len(fresh))
    drop_files(spark, folder, file, sorted(set(layouts[0].files) - set(stays.values())))
    discard(base)
    paths = listed(spark, folder)
    place = {stays.get(k, k): (*where, k not in stays) for k, where in layouts[1].files.items()}
    if not paths:
        return spark.createDataFrame([], RESULT)
    late = ~F.expr(f"cast(`{arrival}` as timestamp_ntz) < TIMESTAMP_NTZ'{before}'")
    tasks = max(1, min(len(paths), 4 * spark.sparkContext.defaultParallelism))
    found, written = read_back(spark, folder, identity, late, tasks)
    at = spark.createDataFrame([(k, *place[k], ",".join(written), p) for k, ps in paths.items() for p in ps], "file int, leaf string, part long, rewritten boolean, columns string, path string")
    return found.join(F.broadcast(at), "file").select(*[c.split()[0] for c in RESULT.split(", ")])


def click_moment() -> Column:
    """ts; of ids whose checksum k modulo 128 is below 16, (k + 6)^3 days before that; of those above 111, the Monday before it."""
    k = F.crc32(F.col("click_id").cast("string").cast("binary")) % 128
    m = micros("ts")
    day = (_below(m, DAY) / F.lit(DAY)).cast("long")
    monday = (day - F.pmod(day + 3, F.lit(7))) * F.lit(DAY)
    return F.when(k < 16, m - (k + 6) * (k + 6) * (k + 6) * F.lit(DAY)).when(k > 111, monday).otherwise(m)


def op11_time_partitions(clicks: DataFrame) -> DataFrame:
    return laid_out(clicks, click_moment(), "arrived_at", "click_id", "2024-03-01 00:00:00", scratch(clicks.sparkSession, "clicks"))
