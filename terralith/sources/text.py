"""Survey, mesh and configuration text as DataFrames: one row per line in, typed rows out.

Readers take ``lines(path, line_no, line)``, from ``read_lines`` or any other source, so that a
parser never cares where the text came from. Numbers that do not parse make the row a bad row,
not an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terralith.operators.mesh import dense_number
from terralith.operators.storage import partitions, stored

NO_DATA = -9999.0


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no, line) of text files, numbered from 1 within each file.

    Files are read in splits like any text, so a large one is many tasks' work: lines count from
    the start of their split, and splits from the lines of those before them in the file. The
    lines are written once, so that both counts see the same rows.
    """
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("id"), F.col("value").alias("line"))
    held = stored(raw)
    splits = held.groupBy("path", "at").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    earlier = Window.partitionBy("path").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("path", "at", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    return held.join(splits, ["path", "at"]).select("path", (F.col("before") + F.col("id") - F.col("first") + 1).cast("int").alias("line_no"), "line")


def number_lines(texts: DataFrame) -> DataFrame:
    """(path, line_no, line) of rows (path, text)."""
    rows = texts.select("path", F.posexplode(F.split("text", "\r?\n")).alias("n", "line"))
    return rows.select("path", (F.col("n") + 1).alias("line_no"), "line")


def trimmed(c: Column) -> Column:
    """Without blanks, tabs, line ends and quotes at either end."""
    return F.regexp_replace(c, r'^[ \t\r\n"]+|[ \t\r\n"]+$', "")


def number(c: Column) -> Column:
    return c.try_cast("double")


def yes(c: Column) -> Column:
    """Whether a flag says yes, true or 1."""
    return F.lower(trimmed(c)).isin("yes", "true", "1")


def number_or_null(c: Column) -> Column:
    """A number; n/a, NA, empty and anything else that is no number are null."""
    return number(trimmed(c))


def fields(line: Column, sep: str = ",") -> Column:
    """Trimmed fields; empty ones are dropped, so later ones move left."""
    return F.filter(F.transform(F.split(line, sep), trimmed), lambda x: x != "")


def survey(lines: DataFrame, kind: str, least: int = 4) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad rows) of x, y, z, value[, std] text.

    Blank lines and lines from # are skipped, and lines whose first field starts with a letter
    (headers). std is 0 where it is not given.
    """
    rows = lines.withColumn("__f", fields(F.col("line"))).filter((F.size("__f") > 0) & ~F.ltrim("line").startswith("#"))
    rows = rows.filter(~F.col("__f")[0].rlike("^[A-Za-z]"))
    values = [number(F.get("__f", F.lit(i))) for i in range(5)]
    fine = (F.size("__f") >= least) & F.forall(F.slice("__f", 1, 5), lambda x: number(x).isNotNull())
    good = rows.filter(fine).select("path", "line_no", F.lit(kind).alias("kind"), *[v.alias(n) for v, n in zip(values[:4], ("x", "y", "z", "value"), strict=True)], F.coalesce(values[4], F.lit(0.0)).alias("std"))
    return good, rows.filter(~fine).select("path", "line_no", "line")


def constraints(lines: DataFrame) -> DataFrame:
    """x, y, z_top, z_bottom, group of text with five fields; the group is cut to an integer."""
    rows = lines.withColumn("__f", fields(F.col("line"))).filter((F.size("__f") >= 5) & ~F.ltrim("line").startswith("#"))
    v = [number(F.col("__f")[i]) for i in range(5)]
    out = rows.select("path", "line_no", *[c.alias(n) for c, n in zip(v[:4], ("x", "y", "z_top", "z_bottom"), strict=True)], v[4].cast("int").alias("litho_group_id"))
    return out.dropna()


def clusters(lines: DataFrame) -> DataFrame:
    """Cluster properties from 11 or 15 comma-separated fields; a first line from cluster_id is a header."""
    raw = F.transform(F.split("line", ","), trimmed)
    rows = lines.withColumn("__f", raw).filter((F.size("__f") >= 11) & ~((F.col("line_no") == 1) & (F.col("__f")[0] == "cluster_id")))
    at = lambda i: F.get("__f", F.lit(i))
    names = ["density_median", "density_p10", "density_p90", "susceptibility_median", "susceptibility_p10", "susceptibility_p90"]
    more = ["remanence_magnitude", "remanence_inclination", "remanence_declination"]
    return rows.select(
        at(0).try_cast("int").alias("cluster_id"), at(1).alias("working_name"), at(2).try_cast("long").alias("sample_count"),
        *[number(at(3 + i)).alias(n) for i, n in enumerate(names)], yes(at(9)).alias("has_density"), yes(at(10)).alias("has_susceptibility"),
        *[number_or_null(at(11 + i)).alias(n) for i, n in enumerate(more)], F.coalesce(yes(at(14)), F.lit(False)).alias("has_remanence"),
    )


def gates(lines: DataFrame) -> DataFrame:
    """Gates by header name: cluster_name, density_min, density_max[, susc_min, susc_max].

    Required columns must be there (an error names the missing ones); a missing or empty
    susceptibility bound is infinite. ord counts the gates of a file from 0.
    """
    head = lines.filter("line_no = 1").select(F.transform(F.split("line", ","), lambda x: F.lower(trimmed(x))).alias("h")).first()
    names = head["h"] if head else []
    missing = [c for c in ("cluster_name", "density_min", "density_max") if c not in names]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    rows = lines.filter((F.col("line_no") > 1) & (F.trim("line") != "")).withColumn("__f", F.transform(F.split("line", ","), trimmed))
    get = lambda c: F.get("__f", F.lit(names.index(c))) if c in names else F.lit(None).cast("string")
    inf = float("inf")
    return rows.select(
        (F.col("line_no") - 2).alias("ord"), get("cluster_name").alias("name"), number(get("density_min")).alias("d_min"), number(get("density_max")).alias("d_max"),
        F.coalesce(number(get("susc_min")), F.lit(-inf)).alias("s_min"), F.coalesce(number(get("susc_max")), F.lit(inf)).alias("s_max"),
    )


def missing_columns(lines: DataFrame, required: list[str]) -> DataFrame:
    """(path, missing): the required columns that a file's first line does not name, in order."""
    names = F.transform(F.split("line", ","), lambda x: F.lower(trimmed(x)))
    return lines.filter("line_no = 1").select("path", F.array_except(F.array(*[F.lit(c) for c in required]), names).alias("missing"))


def cluster_rows(lines: DataFrame) -> DataFrame:
    """(path, line_no, header, row): data lines of a CSV with its header as arrays, nothing dropped."""
    head = lines.filter("line_no = 1").select("path", F.split("line", ",").alias("header"))
    rows = lines.filter((F.col("line_no") > 1) & (F.trim("line") != ""))
    return rows.join(F.broadcast(head), "path").select("path", "line_no", "header", F.split("line", ",").alias("row"))


def rewrite_rows(rows: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """(path, line_no, line): ``cluster_rows`` as text again, with changed fields.

    changes(key, column, value): a field takes the value where the row's ``key`` column says
    so; columns and rows keep their order, and columns that nobody knows are kept too.
    """
    own = F.element_at(F.map_from_arrays("header", F.slice("row", F.lit(1), F.size("header"))), F.lit(key))
    by_key = changes.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("column", "value"))).alias("new"))
    out = rows.withColumn("key", own).join(by_key, "key", "left")
    fields_ = F.zip_with("header", "row", lambda h, x: F.coalesce(F.element_at(F.col("new"), h), x))
    body = out.select("path", "line_no", F.array_join(F.when(F.col("new").isNull(), F.col("row")).otherwise(fields_), ",", "").alias("line"))
    heads = rows.groupBy("path").agg(F.array_join(F.first("header"), ",").alias("line")).select("path", F.lit(1).alias("line_no"), "line")
    return heads.unionByName(body)


def observed(spark: SparkSession, path: str) -> DataFrame:
    """x, y, z, value of an observed CSV with a header; one row of zeros where the file is absent."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.range(1).select(*[F.lit(0.0).alias(c) for c in ("x", "y", "z", "value")])
    rows = read_lines(spark, path).filter((F.col("line_no") > 1) & (F.trim("line") != "")).select(F.split("line", ",").alias("f"))
    return rows.select(*[number(F.get("f", F.lit(i))).alias(c) for i, c in enumerate(("x", "y", "z", "value"))])


def by_header(lines: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Columns found by the names in the first line; shorter rows are dropped. columns: name to type."""
    head = lines.filter("line_no = 1").first()
    names = [x.strip().strip('"') for x in head["line"].split(",")] if head else []
    missing = [c for c in columns if c not in names]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    need = max(names.index(c) for c in columns) + 1
    rows = lines.filter("line_no > 1").withColumn("__f", F.transform(F.split("line", ","), trimmed)).filter(F.size("__f") >= need)
    return rows.select(*[F.get("__f", F.lit(names.index(c))).try_cast(t).alias(c) for c, t in columns.items()])


def by_position(lines: DataFrame, columns: dict[int, tuple[str, str]], header: bool = True) -> DataFrame:
    """Columns by position; rows that are too short or hold no number where one is due are dropped."""
    need = max(columns) + 1
    rows = lines.filter(F.col("line_no") > int(header)).withColumn("__f", F.transform(F.split("line", ","), trimmed)).filter(F.size("__f") >= need)
    return rows.select(*[F.get("__f", F.lit(i)).try_cast(t).alias(n) for i, (n, t) in columns.items()]).dropna()


def points(lines: DataFrame) -> DataFrame:
    """First three columns of a point cloud; header and # lines are skipped."""
    rows = lines.withColumn("__f", fields(F.col("line"))).filter((F.size("__f") >= 3) & ~F.ltrim("line").startswith("#"))
    return rows.select("path", "line_no", *[number(F.col("__f")[i]).alias(c) for i, c in enumerate("xyz")]).dropna()


def dem(lines: DataFrame) -> DataFrame:
    """Heights by place from x y z text (blanks or commas; # and ; start comments); the last line of a place wins."""
    rows = lines.filter(~F.ltrim("line").rlike("^[#;]")).withColumn("__f", F.filter(F.split("line", r"[\s,]+"), lambda x: x != "")).filter(F.size("__f") >= 3)
    rows = rows.select("line_no", *[number(F.col("__f")[i]).alias(c) for i, c in enumerate("xyz")]).dropna()
    return rows.groupBy("x", "y").agg(F.max_by("z", "line_no").alias("z"))


def ini(lines: DataFrame) -> DataFrame:
    """(path, section, key, value) of INI text: key = value or key: value, # and ; comments, later wins."""
    w = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    clean = lines.withColumn("t", F.trim(F.regexp_replace("line", r"\s*[#;].*$", "")))
    section = F.regexp_extract("t", r"^\[([^\]]*)\]$", 1)
    rows = clean.withColumn("section", F.coalesce(F.last(F.when(F.col("t").rlike(r"^\[.*\]$"), F.trim(section)), True).over(w), F.lit("")))
    rows = rows.filter(F.col("t").rlike(r"^[^\[=:][^=:]*[=:]"))
    rows = rows.select("path", "line_no", "section", F.trim(F.regexp_extract("t", r"^([^=:]+)[=:]", 1)).alias("key"), F.trim(F.regexp_extract("t", r"^[^=:]+[=:](.*)$", 1)).alias("value"))
    return rows.groupBy("path", "section", "key").agg(F.max_by("value", "line_no").alias("value"))


def group_json(texts: DataFrame, column: str = "text") -> DataFrame:
    """Groups of a JSON configuration {bottom_depth, groups: [{id, name, density}]}."""
    schema = "bottom_depth double, groups array<struct<id:int,name:string,density:double>>"
    parsed = texts.select(F.from_json(column, schema).alias("j")).filter("j is not null")
    return parsed.select("j.bottom_depth", F.explode("j.groups").alias("g")).select("bottom_depth", "g.*")


def property_values(lines: DataFrame, xyz: bool = False) -> DataFrame:
    """(cell, value): one value a line, or the fourth column of xyz text with a header.

    The first line of plain text is skipped if it has three fields. Cells count from 0.
    """
    parts = F.filter(F.split(F.trim("line"), r"[\s,]+"), lambda x: x != "")
    rows = lines.withColumn("__f", parts).filter(F.size("__f") > 0)
    if xyz:
        good = rows.filter("line_no > 1").select("path", "line_no", number(F.get("__f", F.lit(3))).alias("value"))
    else:
        good = rows.filter(~((F.col("line_no") == 1) & (F.size("__f") == 3))).select("path", "line_no", number(F.col("__f")[0]).alias("value"))
    w = Window.partitionBy("path").orderBy("line_no")
    return good.filter("value is not null").select((F.row_number().over(w) - 1).alias("cell"), "value")


def convergence(lines: DataFrame) -> DataFrame:
    """Iteration metrics from a run's log: 'iter N ... objective=.. rms=..'; other lines are skipped."""
    rows = lines.filter(F.col("line").rlike(r"(?i)iter(?:ation)?\s*[:#]?\s*\d+"))
    grab = lambda name: number(F.regexp_extract("line", rf"(?i)\b{name}\s*[=:]\s*([-+0-9.eE]+)", 1))
    it = F.regexp_extract("line", r"(?i)iter(?:ation)?\s*[:#]?\s*(\d+)", 1).cast("int")
    return rows.select("path", "line_no", it.alias("iteration"), *[grab(n).alias(n) for n in ("objective", "gravity", "magnetic", "rms")])


def tensor_mesh(lines: DataFrame) -> DataFrame:
    """nx, ny, nz, x0, y0, z0, dx, dy, dz of UBC mesh text; the first width of each axis counts.

    Widths may be written n*w.
    """
    parts = F.filter(F.split(F.trim("line"), r"\s+"), lambda x: x != "")
    rows = lines.filter(F.trim("line") != "").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("line_no", parts.alias("f")))).alias("l"))
    at = lambda i, j: F.col("l")[i]["f"][j]
    width = lambda i: number(F.substring_index(at(i, 0), "*", -1))
    return rows.select(
        "path", *[at(0, j).cast("int").alias(n) for j, n in enumerate(("nx", "ny", "nz"))], *[number(at(1, j)).alias(n) for j, n in enumerate(("x0", "y0", "z0"))],
        *[width(2 + j).alias(n) for j, n in enumerate(("dx", "dy", "dz"))],
    )


def obj(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vertices, triangles) of OBJ text: v and f lines, i/j/k keeps i, polygons become fans; ids from 0."""
    parts = F.filter(F.split(F.trim("line"), r"\s+"), lambda x: x != "")
    rows = lines.withColumn("__f", parts)
    w = Window.partitionBy("path").orderBy("line_no")
    v = rows.filter((F.get("__f", F.lit(0)) == "v") & (F.size("__f") >= 4))
    vertices = v.select("path", (F.row_number().over(w) - 1).cast("long").alias("v_id"), *[number(F.col("__f")[i + 1]).alias(c) for i, c in enumerate("xyz")])
    f = rows.filter(F.get("__f", F.lit(0)).isin("f", "fo") & (F.size("__f") >= 4))
    ids = F.transform(F.slice("__f", 2, 1 << 20), lambda x: F.substring_index(x, "/", 1).cast("long") - 1)
    fan = f.select("path", "line_no", ids.alias("i")).select("path", "line_no", "i", F.explode(F.sequence(F.lit(1), F.size("i") - 2)).alias("k"))
    tri = fan.select("path", "line_no", "k", F.col("i")[0].alias("v0"), F.expr("i[k]").alias("v1"), F.expr("i[k + 1]").alias("v2"))
    return vertices, tri.select("path", (F.row_number().over(Window.partitionBy("path").orderBy("line_no", "k")) - 1).cast("long").alias("t_id"), "v0", "v1", "v2")


def tsurf(lines: DataFrame, honour_ids: bool = True) -> tuple[DataFrame, DataFrame]:
    """(vertices, triangles) of TSurf text: VRTX/PVRTX id x y z and TRGL a b c up to END.

    ``honour_ids``: triangles name vertex ids; else ids are ignored and count the lines from 1.
    Vertex numbers of the result count from 0 in file order.
    """
    parts = F.filter(F.split(F.trim("line"), r"\s+"), lambda x: x != "")
    # a file is not one task: its end is an aggregate, its rows are numbered in ranges
    ends = lines.filter(F.trim("line") == "END").groupBy("path").agg(F.min("line_no").alias("__last"))
    rows = lines.join(F.broadcast(ends), "path", "left").filter(F.col("__last").isNull() | (F.col("line_no") < F.col("__last"))).withColumn("__f", parts)
    kind = F.get("__f", F.lit(0))
    v = rows.filter(kind.isin("VRTX", "PVRTX") & (F.size("__f") >= 5))
    v = v.select("path", "line_no", F.col("__f")[1].cast("long").alias("file_id"), *[number(F.col("__f")[i + 2]).alias(c) for i, c in enumerate("xyz")])
    v = _numbered_by_path(v, "v_id").select("path", "v_id", "file_id", "x", "y", "z")
    t = rows.filter((kind == "TRGL") & (F.size("__f") >= 4))
    t = t.select("path", "line_no", *[F.col("__f")[i + 1].cast("long").alias(f"f{i}") for i in range(3)])
    t = _numbered_by_path(t, "t_id").select("path", "t_id", "f0", "f1", "f2")
    if honour_ids:
        for i in range(3):
            t = t.join(v.select("path", F.col("file_id").alias(f"f{i}"), F.col("v_id").alias(f"v{i}")), ["path", f"f{i}"])
    else:
        t = t.select("*", *[(F.col(f"f{i}") - 1).alias(f"v{i}") for i in range(3)])
    return v.drop("file_id"), t.select("path", "t_id", "v0", "v1", "v2")


def _numbered_by_path(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` numbered from 0 in each path by ``line_no``."""
    all_rows = dense_number(rows, ["path", "line_no"], name, parts=partitions(rows))
    firsts = all_rows.groupBy("path").agg(F.min(name).alias("__first"))
    return all_rows.join(F.broadcast(firsts), "path").withColumn(name, F.col(name) - F.col("__first")).drop("__first")


def tsurf_names(lines: DataFrame) -> DataFrame:
    """(path, name): the name in a TSurf header ('name:...' up to its closing brace), '' if none."""
    end = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    head = lines.withColumn("closed", F.max((F.trim("line") == "}").cast("int")).over(end)).filter("closed = 0")
    name = F.regexp_extract("line", r"(?i)^\s*\*?name\s*:\s*(.*?)\s*$", 1)
    return head.groupBy("path").agg(F.coalesce(F.min_by(F.when(name != "", name), F.when(name != "", F.col("line_no"))), F.lit("")).alias("name"))


def load_mesh(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(vertices, triangles) by the path's lower-cased extension: .obj or .ts."""
    lines = read_lines(spark, path)
    name = path.lower()
    if name.endswith(".obj"):
        return obj(lines)
    if name.endswith(".ts"):
        return tsurf(lines)
    raise ValueError(f"no reader for {path}")


def label_grid(spark: SparkSession, path: str) -> DataFrame:
    """(ix, iy, iz, label) of a label file: a header line 'nx ny nz ...', then int32 with x fastest.

    The length must fit the header.
    """
    import numpy as np
    import pandas as pd

    def parse(batches):
        for pdf in batches:
            for content in pdf["content"]:
                head, _, body = content.partition(b"\n")
                nx, ny, nz = (int(x) for x in head.split()[:3])
                values = np.frombuffer(body, "<i4")
                if len(values) != nx * ny * nz:
                    raise ValueError("label block and header differ in size")
                i = np.arange(len(values))
                yield pd.DataFrame({"ix": i % nx, "iy": i // nx % ny, "iz": i // (nx * ny), "label": values}).astype("int32")

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(parse, "ix int, iy int, iz int, label int")


def active_cells(lines: DataFrame) -> DataFrame:
    """Cells of an active-cell mesh: dims, origin (z of the top), sizes, count, then ix iy iz from 1.

    (cell from 1, ix, iy, iz, x, y, z of the centre; z falls with iz).
    """
    parts = F.transform(F.filter(F.split(F.trim("line"), r"\s+"), lambda x: x != ""), number)
    rows = lines.filter(F.trim("line") != "").select("path", "line_no", parts.alias("f"))
    head = rows.filter("line_no <= 4").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("line_no", "f"))).alias("h"))
    cells = rows.filter("line_no > 4").join(F.broadcast(head), "path")
    at = lambda i, j: F.col("h")[i]["f"][j]
    index = [F.col("f")[j].cast("int").alias(n) for j, n in enumerate(("ix", "iy", "iz"))]
    centre = [(at(1, j) + (F.col("f")[j] - 0.5) * at(2, j) * (-1 if c == "z" else 1)).alias(c) for j, c in enumerate("xyz")]
    return cells.select("path", (F.col("line_no") - 4).cast("int").alias("cell"), *index, *centre)


def strict_model(texts: DataFrame) -> DataFrame:
    """(path, place, value) of model texts(path, text): three integers, then as many numbers as their product.

    Numbers may stand any number to a line; another count is an error.
    """
    tokens = F.filter(F.split("text", r"\s+"), lambda x: x != "")
    rows = texts.select("path", tokens.alias("k"))
    want = F.col("k")[0].cast("int") * F.col("k")[1].cast("int") * F.col("k")[2].cast("int")
    fits = F.size("k") - 3 == want
    checked = rows.select("path", F.when(fits, F.slice("k", F.lit(4), F.greatest(want, F.lit(1)))).otherwise(F.raise_error(F.lit("model text: values and dimensions differ"))).alias("v"))
    return checked.select("path", F.posexplode("v").alias("place", "v")).select("path", "place", number(F.col("v")).alias("value"))


def strict_model_lines(lines: DataFrame) -> DataFrame:
    """(place, value) of one model file's lines, as ``strict_model`` but in splits of the file.

    Tokens are numbered in sorted ranges, so no task sees the whole file; another count of
    values than the dimensions ask for, or fewer than three integers, is an error.
    """
    from terralith.operators.mesh import dense_number
    from terralith.operators.storage import stored

    tokens = F.filter(F.split("line", r"\s+"), lambda x: x != "")
    rows = lines.select("line_no", F.posexplode(tokens).alias("at", "token"))
    numbered = stored(dense_number(rows, ["line_no", "at"], "place", -3).select("place", "token"))
    head = [r.token for r in numbered.filter("place < 0").orderBy("place").collect()]
    if len(head) < 3 or not all(x.lstrip("-").isdigit() for x in head):
        raise ValueError("model text: three dimensions come first")
    if numbered.filter("place >= 0").count() != int(head[0]) * int(head[1]) * int(head[2]):
        raise ValueError("model text: values and dimensions differ")
    return numbered.filter("place >= 0").select("place", number(F.col("token")).alias("value"))
