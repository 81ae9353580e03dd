"""Lines and files for meshes, grids, logs and property tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def safe_name(name: Column) -> Column:
    return F.regexp_replace(name, r"[ \-.()]", "_")


def vertex_lines(vertices: DataFrame, places: int = 3) -> DataFrame:
    """(ord, line): index and coordinates."""
    return vertices.select(F.col("v_id").alias("ord"), F.format_string(f"%d %.{places}f %.{places}f %.{places}f", "v_id", "x", "y", "z").alias("line"))


def triangle_lines(triangles: DataFrame) -> DataFrame:
    return triangles.select(F.col("t_id").alias("ord"), F.format_string("%d %d %d %d", "t_id", "v0", "v1", "v2").alias("line"))


def obj_lines(vertices: DataFrame, triangles: DataFrame, places: int = 3) -> DataFrame:
    """(part, ord, line) of an OBJ file, faces from 1."""
    v = vertices.select(F.lit(0).alias("part"), F.col("v_id").alias("ord"), F.format_string(f"v %.{places}f %.{places}f %.{places}f", "x", "y", "z").alias("line"))
    t = triangles.select(F.lit(1).alias("part"), F.col("t_id").alias("ord"), F.format_string("f %d %d %d", F.col("v0") + 1, F.col("v1") + 1, F.col("v2") + 1).alias("line"))
    return v.unionByName(t)


def tsurf_lines(vertices: DataFrame, triangles: DataFrame, name: str, places: int | None = None) -> DataFrame:
    """(part, ord, line) of a TSurf file: header, VRTX, TRGL, END.

    Coordinates have 8 places in scientific form, or ``places`` plain ones.
    """
    form = "%.8e" if places is None else f"%.{places}f"
    spark = vertices.sparkSession
    head = spark.createDataFrame([(0, i, x) for i, x in enumerate(["GOCAD TSurf 1", "HEADER {", f"name:{name}", "}", "TFACE"])] + [(3, 0, "END")], "part int, ord long, line string")
    v = vertices.select(F.lit(1).alias("part"), F.col("v_id").alias("ord"), F.format_string(f"VRTX %d {form} {form} {form}", F.col("v_id") + 1, "x", "y", "z").alias("line"))
    t = triangles.select(F.lit(2).alias("part"), F.col("t_id").alias("ord"), F.format_string("TRGL %d %d %d", F.col("v0") + 1, F.col("v1") + 1, F.col("v2") + 1).alias("line"))
    return head.unionByName(v).unionByName(t)


def write_lines(lines: DataFrame, path: str) -> None:
    """One text file of (part, ord, line) in order: a single sorted stream, as the formats ask."""
    keys = [c for c in ("part", "ord") if c in lines.columns]
    lines.repartition(1).sortWithinPartitions(*keys).select("line").write.mode("overwrite").text(path)


def predicted(obs: DataFrame, predictions: DataFrame) -> DataFrame:
    """Observed, predicted and residual by observation."""
    return obs.join(predictions, "obs_id").select("obs_id", "x", "y", "z", F.col("value").alias("observed"), "predicted", (F.col("value") - F.col("predicted")).alias("residual"))


def cell_table(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """Cells with name and density of their group; '' and 0 where the group is unknown."""
    joined = cells.join(F.broadcast(groups.select(F.col("group_id").alias("label"), "name", F.col("density").alias("group_density"))), "label", "left")
    return joined.withColumn("name", F.coalesce("name", F.lit(""))).withColumn("group_density", F.coalesce("group_density", F.lit(0.0)))


def cluster_table(summary: DataFrame) -> DataFrame:
    """Mean less and plus a deviation as p10 and p90; susceptibility not under 0; flag of any at all."""
    return summary.select(
        "label", "n", "density_mean", (F.col("density_mean") - F.col("density_std")).alias("density_p10"), (F.col("density_mean") + F.col("density_std")).alias("density_p90"),
        F.greatest(F.lit(0.0), F.col("susceptibility_mean") - F.col("susceptibility_std")).alias("susceptibility_p10"),
        (F.col("susceptibility_mean") + F.col("susceptibility_std")).alias("susceptibility_p90"), (F.abs("susceptibility_mean") > 1e-12).alias("has_susceptibility"),
    )


def model_values(cells: DataFrame, air: float = -9999.0) -> DataFrame:
    """(ord, line) of a model file: y outermost, then x, then depth from the top; air where null."""
    order = F.struct("iy", "ix", "iz")
    return cells.select(order.alias("ord"), F.format_string("%.6f", F.coalesce("value", F.lit(air))).alias("line"))


def log_lines(history: DataFrame, columns: list[str]) -> DataFrame:
    """(ord, line): tab-separated metrics by iteration."""
    return history.select(F.col("iteration").alias("ord"), F.concat_ws("\t", F.col("iteration").cast("string"), *[F.format_string("%.6f", F.col(c)) for c in columns]).alias("line"))


def label_slabs(cells: DataFrame, shape: tuple[int, int, int], fill: int = -1) -> DataFrame:
    """(iz, block): the int32 bytes of each horizontal slab of a label grid, x fastest.

    Cells that are absent get ``fill``. A slab is one task's work; no task holds the grid.
    """
    import numpy as np
    import pandas as pd

    nx, ny, nz = shape

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        block = np.full((ny, nx), fill, "<i4")
        own = pdf[pdf["ix"].notna()]
        block[own["iy"].astype(int), own["ix"].astype(int)] = own["label"]
        return pd.DataFrame({"iz": [int(pdf["iz"].iloc[0])], "block": [block.tobytes()]})

    every = cells.sparkSession.range(nz).select(F.col("id").cast("int").alias("iz"))
    inside = F.col("ix").between(0, nx - 1) & F.col("iy").between(0, ny - 1)
    rows = every.join(cells.filter(inside).select("ix", "iy", F.col("iz").cast("int").alias("iz"), F.col("label").cast("int").alias("label")), "iz", "left")
    return rows.groupBy("iz").applyInPandas(pack, "iz int, block binary")


def write_label_grid(cells: DataFrame, shape: tuple[int, int, int], path: str) -> None:
    """A label grid file: header line, then the slabs, streamed one at a time through the driver."""
    spark = cells.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(bytearray(" ".join(map(str, shape)).encode() + b"\n"))
        for row in label_slabs(cells, shape).orderBy("iz").toLocalIterator():
            out.write(bytearray(row["block"]))
    finally:
        out.close()


def surface_csv(vertices: DataFrame) -> DataFrame:
    """(part, ord, line) of a point file: x,y,z with three places under a header."""
    head = vertices.sparkSession.range(1).select(F.lit(0).alias("part"), F.lit(0).cast("long").alias("ord"), F.lit("x,y,z").alias("line"))
    return head.unionByName(vertices.select(F.lit(1).alias("part"), F.col("v_id").cast("long").alias("ord"), F.format_string("%.3f,%.3f,%.3f", "x", "y", "z").alias("line")))


def convergence_csv(history: DataFrame) -> DataFrame:
    """(part, ord, line) of a convergence file: iteration and its four terms with six digits."""
    terms = ["beta", "phi_d", "phi_m", "f"]
    head = history.sparkSession.range(1).select(F.lit(0).alias("part"), F.lit(0).cast("long").alias("ord"), F.lit(",".join(["iter", *terms])).alias("line"))
    line = F.concat_ws(",", F.col("iteration").cast("string"), *[F.format_string("%.6e", F.col(c)) for c in terms])
    return head.unionByName(history.select(F.lit(1).alias("part"), F.col("iteration").cast("long").alias("ord"), line.alias("line")))


def bundle(vertices: DataFrame, triangles: DataFrame, path: str, key: str = "group_id") -> None:
    """All groups' meshes under ``path``: obj, ts and csv, a folder each by format and group.

    One job for all groups: rows are dealt by group and format, and each file is one sorted
    stream. vertices(key, v_id, ...) and triangles(key, t_id, ...) count from 0 in each group.
    """
    names = vertices.select(key).distinct()
    v = vertices.select(key, F.lit(1).alias("part"), F.col("v_id").cast("long").alias("ord"), "x", "y", "z")
    t = triangles.select(key, F.lit(2).alias("part"), F.col("t_id").cast("long").alias("ord"), *[(F.col(c) + 1).alias(c) for c in ("v0", "v1", "v2")])
    rows = [
        v.select(key, F.lit("obj").alias("format"), "part", "ord", F.format_string("v %.3f %.3f %.3f", "x", "y", "z").alias("line")),
        t.select(key, F.lit("obj"), "part", "ord", F.format_string("f %d %d %d", "v0", "v1", "v2")),
        v.select(key, F.lit("csv"), "part", "ord", F.format_string("%.3f,%.3f,%.3f", "x", "y", "z")),
        names.select(key, F.lit("csv"), F.lit(0), F.lit(0).cast("long"), F.lit("x,y,z")),
        v.select(key, F.lit("ts"), "part", "ord", F.format_string("VRTX %d %.8e %.8e %.8e", F.col("ord") + 1, "x", "y", "z")),
        t.select(key, F.lit("ts"), "part", "ord", F.format_string("TRGL %d %d %d", "v0", "v1", "v2")),
        names.select(key, F.lit("ts"), F.lit(3), F.lit(0).cast("long"), F.lit("END")),
    ]
    head = F.posexplode(F.array(F.lit("GOCAD TSurf 1"), F.lit("HEADER {"), F.concat(F.lit("name:volume_group_"), F.col(key).cast("string")), F.lit("}"), F.lit("TFACE"))).alias("ord", "line")
    out = names.select(key, F.lit("ts").alias("format"), F.lit(0).alias("part"), head).withColumn("ord", F.col("ord").cast("long"))
    for more in rows:
        out = out.union(more)
    out = out.withColumn("group", F.col(key).cast("string"))
    out.repartition("format", "group").sortWithinPartitions("format", "group", "part", "ord").select("format", "group", "line").write.mode("overwrite").partitionBy("format", "group").text(path)


def export_lines(vertices: DataFrame, triangles: DataFrame, properties: DataFrame) -> DataFrame:
    """(file, part, ord, line) of everything a model is exported as.

    vertices: group_id, v_id from 0 in each group, x, y, z; triangles: group_id, t_id, v0..v2;
    properties: group_id, name, density, susceptibility. Files: the closed volume of each group
    (TSurf) with its name and properties in the header, its surface points (CSV), the starting
    model (one CSV of all groups), and a manifest with the lines and characters of each file.
    """
    group = F.col("group_id").cast("string")
    ts, csv = F.concat(F.lit("volume_group_"), group, F.lit(".ts")), F.concat(F.lit("surface_group_"), group, F.lit(".csv"))
    row = lambda df, file, part, order, line: df.select(file.alias("file"), F.lit(part).alias("part"), order.cast("long").alias("ord"), line.alias("line"))
    start = F.lit("starting_model.csv")
    known = properties.select("group_id", "name", "density", "susceptibility")
    head = F.array(
        F.lit("GOCAD TSurf 1"), F.lit("HEADER {"), F.concat(F.lit("name:"), safe_name(F.col("name"))), F.format_string("*density:%.6f", "density"), F.format_string("*susceptibility:%.6f", "susceptibility"),
        F.lit("}"), F.lit("TFACE"),
    )
    heads = known.select(*known.columns, F.posexplode(head).alias("at", "text"))
    rows = [
        row(heads, ts, 0, F.col("at"), F.col("text")),
        row(vertices, ts, 1, F.col("v_id"), F.format_string("VRTX %d %.3f %.3f %.3f", F.col("v_id") + 1, "x", "y", "z")),
        row(triangles, ts, 2, F.col("t_id"), F.format_string("TRGL %d %d %d", F.col("v0") + 1, F.col("v1") + 1, F.col("v2") + 1)),
        row(known, ts, 3, F.lit(0), F.lit("END")),
        row(known, csv, 0, F.lit(0), F.lit("x,y,z")),
        row(vertices, csv, 1, F.col("v_id"), F.format_string("%.3f,%.3f,%.3f", "x", "y", "z")),
        row(vertices.sparkSession.range(1), start, 0, F.lit(0), F.lit("group_id,name,density,susceptibility")),
        row(known, start, 1, F.col("group_id"), F.format_string("%d,%s,%.6f,%.6f", F.col("group_id").cast("long"), "name", "density", "susceptibility")),
    ]
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    sizes = out.groupBy("file").agg(F.count("*").alias("n"), F.sum(F.length("line")).alias("size"))
    listed = row(sizes.withColumn("of", F.col("file")), F.lit("manifest.csv"), 0, F.lit(0), F.format_string("%s,%d,%d", "of", "n", "size"))
    return out.unionByName(listed)


def export_set(lines: DataFrame, path: str) -> None:
    """``export_lines`` as one folder a file under ``path``, all of them or none.

    One job deals the rows by file and sorts each file. It writes beside ``path`` and takes
    its place by a rename at the end, so a failed or repeated run leaves either the old set or
    the new one.
    """
    import uuid

    spark = lines.sparkSession
    beside = f"{path}.writing-{uuid.uuid4().hex}"
    keys = ["file", "part", "ord", "line"]
    lines.repartition("file").sortWithinPartitions(*keys).select("file", "line").write.partitionBy("file").text(beside)
    at = spark._jvm.org.apache.hadoop.fs.Path
    files = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    files.delete(at(path), True)
    if not files.rename(at(beside), at(path)):
        raise OSError(f"{beside} could not take the place of {path}")


def mesh_text(shape: tuple[int, int, int], origin: tuple[float, float, float], size: tuple[float, float, float]) -> list[str]:
    """Lines of a UBC mesh with equal cells."""
    head = [" ".join(map(str, shape)), " ".join(f"{x:.3f}" for x in origin)]
    return head + [f"{n}*{s:.3f}" for n, s in zip(shape, size, strict=True)]


def relative_path(target: str | None, ini_path: str) -> str:
    """``target`` as seen from the folder of the INI file, with forward slashes; '' for none."""
    import posixpath

    if target is None:
        return ""
    return posixpath.relpath(target.replace("\\", "/"), posixpath.dirname(ini_path.replace("\\", "/")) or ".")


def ini_text(options: dict[str, dict[str, object]], ini_path: str | None = None, paths: tuple[str, ...] = ()) -> list[str]:
    """Lines of an INI configuration, sections parted by an empty line where ``ini_path`` is given.

    Then the keys named in ``paths`` are written relative to the INI's folder (lists joined by
    commas), keys without a value are left out, and truth values are written in lower case.
    """
    if ini_path is None:
        return [line for section, keys in options.items() for line in [f"[{section}]", *[f"{k} = {v}" for k, v in keys.items()]]]

    def text(key, value):
        if key in paths:
            return ",".join(relative_path(x, ini_path) for x in ([value] if isinstance(value, str) else value))
        return str(value).lower() if isinstance(value, bool) else str(value)

    blocks = [[f"[{section}]", *[f"{k} = {text(k, v)}" for k, v in keys.items() if v is not None]] for section, keys in options.items()]
    return [line for i, block in enumerate(blocks) for line in ([""] if i else []) + block]


def observed_lines(obs: DataFrame) -> DataFrame:
    """(ord, line): x,y,z,value,std of observations."""
    return obs.select(F.col("obs_id").alias("ord"), F.format_string("%.3f,%.3f,%.3f,%.6f,%.6f", "x", "y", "z", "value", "std").alias("line"))
