"""Document pairs, jobs, progress and their bookkeeping."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textreuse.operators.lineage import checkpointed


def completed(docs: DataFrame, project_id=None) -> DataFrame:
    out = docs.where("status = 'completed'")
    return out if project_id is None else out.where(F.col("project_id") == project_id)


def document_pairs(docs: DataFrame, id_col: str = "doc_id", project: str = "source") -> DataFrame:
    """All unordered pairs of documents of a project: (project, left_document_id, right_document_id). The pairs are the
    result; they are as many as the projects' sizes make them."""
    side = lambda s: docs.select(F.col(project).alias("project_id"), F.col(id_col).alias(f"{s}_document_id"))
    return side("left").join(side("right"), "project_id").where("left_document_id < right_document_id")


def spread_pairs(docs: DataFrame, *carried: str, project: str = "source", id_col: str = "doc_id", block: int = 2048) -> DataFrame:
    """document_pairs with the columns `carried` of both documents, as left_ and right_. Every two blocks of documents of a
    project are a row, dealt to many tasks, and the pairs, which are the result, are made where they leave: in no shuffle."""
    rows = docs.select(F.col(project).alias("project_id"), F.struct(F.col(id_col).alias("document_id"), *carried).alias("_d"))
    rows = checkpointed(rows.where("project_id is not null and _d.document_id is not null"))
    sizes = checkpointed(rows.groupBy("project_id").agg(F.count("*").alias("_c"), F.ceil(F.count("*") / block).cast("int").alias("_n")))
    pairs = sizes.agg(F.sum(F.col("_c").cast("double") * F.col("_c"))).first()[0] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(int(pairs) // block**2, 10_000))
    ids = F.col("_d.document_id")
    packed = rows.join(sizes.drop("_c"), "project_id").groupBy("project_id", "_n", F.pmod(F.xxhash64(ids), "_n").cast("int").alias("_b")).agg(F.sort_array(F.collect_list("_d")).alias("_d"))
    packed, all_ = checkpointed(packed), F.explode(F.sequence(F.lit(0), F.col("_n") - 1))
    keys = ["project_id", "_x", "_y"]
    left = packed.select("project_id", F.col("_b").alias("_x"), all_.alias("_y"), F.col("_d").alias("_l")).repartition(parts, *keys)
    right = packed.select("project_id", all_.alias("_x"), F.col("_b").alias("_y"), F.col("_d").alias("_r")).repartition(parts, *keys)
    later = lambda r: r["document_id"] > F.col("_l.document_id")
    pair = lambda r: F.struct(*(x[c].alias(f"{s}_{c}") for s, x in (("left", F.col("_l")), ("right", r)) for c in ("document_id", *carried)))
    met = left.join(right, keys).select("project_id", F.explode("_l").alias("_l"), "_r")
    return met.select("project_id", F.inline(F.transform(F.filter("_r", later), pair)))


def spread_new_pairs(docs: DataFrame, compared: str, project: str = "source", id_col: str = "doc_id") -> DataFrame:
    """The pairs that are still to be compared, where documents with an equal `compared` were compared already. Documents
    without it take no part."""
    pairs = spread_pairs(docs.where(F.col(compared).isNotNull()), compared, project=project, id_col=id_col)
    return pairs.where(F.col(f"left_{compared}") != F.col(f"right_{compared}")).select("project_id", "left_document_id", "right_document_id")


def pairs_with(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", project: str = "source", block: int = 512) -> DataFrame:
    """document_pairs with the numbers that `found` (project, left_document_id, right_document_id, numbers) has of some of
    them, 0 elsewhere. Two blocks of documents meet with the rows found between them, so the pairs, which are the result, are
    made where they leave and in no shuffle."""
    rows = docs.select(F.col(project).alias("_p"), F.col(id_col).alias("_i")).dropna().distinct()
    n = checkpointed(rows.groupBy("_p").agg(F.ceil(F.count("*") / block).alias("_n")))
    dealt = lambda c: F.pmod(F.xxhash64(c), F.col("_n")).cast("int")
    packed = checkpointed(rows.join(n, "_p").groupBy("_p", dealt("_i").alias("_b")).agg(F.sort_array(F.collect_list("_i")).alias("ids")))
    numbers = [c for c in found.columns if c not in (project, "left_document_id", "right_document_id")]
    ends = (F.least("_l", "_r").alias("_x"), F.greatest("_l", "_r").alias("_y"))
    met = found.withColumnRenamed(project, "_p").join(n, "_p").withColumns({"_l": dealt("left_document_id"), "_r": dealt("right_document_id")})
    met = met.groupBy("_p", *ends).agg(F.collect_list(F.struct("left_document_id", "right_document_id", *numbers)).alias("found"))
    side = lambda s: packed.select("_p", F.col("_b").alias(f"_{s}"), F.col("ids").alias(s))
    meet = side("x").join(side("y"), "_p").where("_x <= _y").join(met, ["_p", "_x", "_y"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                x, y = b.column("x")[i].as_py(), b.column("y")[i].as_py()
                if b.column("_x")[i].as_py() == b.column("_y")[i].as_py():
                    ids = x
                    left, right = np.triu_indices(len(ids), 1)
                else:
                    ids = sorted(x + y)
                    one, two = (np.isin(np.arange(len(ids)), [n for n, v in enumerate(ids) if v in s]) for s in map(set, (x, y)))
                    ends = np.repeat(np.flatnonzero(one), len(y)), np.tile(np.flatnonzero(two), len(x))
                    left, right = np.minimum(*ends), np.maximum(*ends)
                at = {v: n for n, v in enumerate(ids)}
                names, rows = pa.array(ids, b.schema.field("x").type.value_type), b.column("found")[i].values
                columns = [np.zeros(len(ids) ** 2, b.schema.field("found").type.value_type.field(c).type.to_pandas_dtype()) for c in numbers]
                if rows is not None:
                    place = np.array([at[v] for v in rows.field("left_document_id").to_pylist()], int) * len(ids) + np.array([at[v] for v in rows.field("right_document_id").to_pylist()], int)
                    for c, values in zip(numbers, columns, strict=True):
                        values[place] = rows.field(c).to_numpy(zero_copy_only=False)
                who = b.column("_p").take(pa.array(np.full(len(left), i)))
                yield pa.RecordBatch.from_arrays(
                    [who, names.take(pa.array(left)), names.take(pa.array(right)), *(pa.array(v[left * len(ids) + right]) for v in columns)], names=["project_id", "left_document_id", "right_document_id", *numbers]
                )

    kind = [docs.schema[project].dataType.simpleString(), *[docs.schema[id_col].dataType.simpleString()] * 2, *(found.schema[c].dataType.simpleString() for c in numbers)]
    names = ["project_id", "left_document_id", "right_document_id", *numbers]
    return meet.mapInArrow(run, ", ".join(f"{c} {k}" for c, k in zip(names, kind, strict=True)))


def pair_places(docs: DataFrame, *within: str, id_col: str = "doc_id") -> DataFrame:
    """A row per document in place of its pairs with the others of its project: (within, document_id, previous_document,
    next_document, n_before, n_after), in the order of ids. It is the right one of n_before pairs and the left one of n_after.

    Documents are dealt by ranges of project and id, and numbered inside a range; so a large project is many tasks."""
    keys = list(within or ("source",))
    rows = docs.select(*keys, F.col(id_col).alias("document_id")).dropna()
    rows = checkpointed(rows.repartitionByRange(*keys, "document_id").withColumn("_range", F.spark_partition_id()))  # fixes the ranges
    inside = Window.partitionBy(*keys, "_range")
    up, down = inside.orderBy("document_id"), inside.orderBy(F.desc("document_id"))
    ranges = rows.groupBy(*keys, "_range").agg(F.count("*").alias("_n"), F.min("document_id").alias("_first"), F.max("document_id").alias("_last"))
    order, back = Window.partitionBy(*keys).orderBy("_range"), Window.partitionBy(*keys).orderBy(F.desc("_range"))
    others = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.select(*keys, "_range", F.lag("_last").over(order).alias("_previous"), F.lead("_first").over(order).alias("_next"), others(order).alias("_below"), others(back).alias("_above"))
    rows = rows.withColumns({"_p": F.lag("document_id").over(up), "_s": F.lead("document_id").over(up), "_b": F.rank().over(up) - 1, "_a": F.rank().over(down) - 1})
    return rows.join(F.broadcast(ranges), [*keys, "_range"]).select(
        *keys, "document_id", F.coalesce("_p", "_previous").alias("previous_document"), F.coalesce("_s", "_next").alias("next_document"), (F.col("_b") + F.col("_below")).alias("n_before"), (F.col("_a") + F.col("_above")).alias("n_after")
    )


def new_pair_places(docs: DataFrame, compared: str, project: str = "source", id_col: str = "doc_id") -> DataFrame:
    """(project, document_id, n_before, n_after) of the pairs that are still to be compared, where documents with an equal
    `compared` were compared already: all pairs less those. Documents without it take no part."""
    known = docs.where(F.col(compared).isNotNull())
    every = pair_places(known, project, id_col=id_col).select(project, "document_id", "n_before", "n_after").distinct()
    had = pair_places(known, project, compared, id_col=id_col).select(project, "document_id", F.col("n_before").alias("_b"), F.col("n_after").alias("_a"))
    return had.join(every, [project, "document_id"]).select(project, "document_id", (F.col("n_before") - F.col("_b")).alias("n_before"), (F.col("n_after") - F.col("_a")).alias("n_after"))


def pair_count(docs: DataFrame, project: str = "source", id_col: str = "doc_id") -> DataFrame:
    """(n): the number of pairs of `document_pairs`, none of which is made."""
    ids = docs.where(F.col(project).isNotNull() & F.col(id_col).isNotNull()).groupBy(project, id_col).agg(F.count("*").alias("n"))
    per = ids.groupBy(project).agg(((F.sum("n") * F.sum("n") - F.sum(F.col("n") * F.col("n"))) / 2).cast("long").alias("n"))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def has_active_documents(docs: DataFrame, project: str = "source", id_col: str = "doc_id") -> DataFrame:
    """(job_id, active) of projects with a pair: whether one of its pairs has a pending or running document. As soon as there
    are two documents, each is in a pair."""
    per = docs.where(F.col(project).isNotNull()).groupBy(F.col(project).alias("job_id")).agg(
        F.max(F.col("status").isin("pending", "running") & F.col(id_col).isNotNull()).alias("active"), (F.min(id_col) < F.max(id_col)).alias("_pairs")
    )
    return per.where("_pairs").drop("_pairs")


def new_pairs(pairs: DataFrame, existing: DataFrame) -> DataFrame:
    """Pairs that are not in existing, whichever way round."""
    had = existing.select(F.least("left_document_id", "right_document_id").alias("left_document_id"), F.greatest("left_document_id", "right_document_id").alias("right_document_id"))
    return pairs.join(had.distinct(), ["left_document_id", "right_document_id"], "left_anti")


def pair_id(left: str = "left_document_id", right: str = "right_document_id"):
    """Both ids, as a string: no two pairs share one."""
    return F.concat_ws("-", left, right)


def pair_navigation(pairs: DataFrame) -> DataFrame:
    """First, previous and next pair among those of the same left document, by right document."""
    w = Window.partitionBy("left_document_id").orderBy("right_document_id")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return pairs.withColumns({"first_right": F.first("right_document_id").over(whole), "previous_right": F.lag("right_document_id").over(w), "next_right": F.lead("right_document_id").over(w)})


def navigated_pairs(docs: DataFrame, project: str = "source", id_col: str = "doc_id") -> DataFrame:
    """pair_navigation and with_labels of all document_pairs. The right documents of a left one are those after it in its
    project, so what stands before and after them follows from their neighbours there. Ids that repeat go by windows."""
    rows = docs.where(F.col(project).isNotNull() & F.col(id_col).isNotNull())
    columns = ["left_document_id", "right_document_id", "first_right", "previous_right", "next_right", "left_label", "right_label"]
    if not rows.groupBy(id_col).count().where("count > 1").isEmpty():
        return with_labels(pair_navigation(document_pairs(docs, id_col, project).drop("project_id")), docs.dropDuplicates([id_col]), id_col).select(*columns)
    label = F.coalesce("title", "filename", F.concat(F.lit("document "), F.col(id_col).cast("string"))).alias("label")
    places = pair_places(docs, project, id_col=id_col).withColumnRenamed("document_id", id_col)
    pairs = spread_pairs(places.join(rows.select(id_col, label), id_col), "previous_document", "next_document", "label", project=project, id_col=id_col)
    before = F.when(F.col("right_previous_document") != F.col("left_document_id"), F.col("right_previous_document"))
    pairs = pairs.withColumnsRenamed({"left_next_document": "first_right", "right_next_document": "next_right"})
    return pairs.withColumn("previous_right", before).select(*columns)


def with_labels(pairs: DataFrame, docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """left_label and right_label: title, else file name, else a made one."""
    for s in ("left", "right"):
        mine = docs.select(F.col(id_col).alias(f"{s}_document_id"), F.coalesce("title", "filename").alias(f"{s}_label"))
        pairs = pairs.join(mine, f"{s}_document_id", "left").withColumn(f"{s}_label", F.coalesce(f"{s}_label", F.concat(F.lit("document "), F.col(f"{s}_document_id").cast("string"))))
    return pairs


def victims(pairs: DataFrame, doc_ids: DataFrame) -> DataFrame:
    """pair_ids with a document of doc_ids (doc_id) on either side."""
    sides = [pairs.join(doc_ids.select(F.col("doc_id").alias(f"{s}_document_id")), f"{s}_document_id", "left_semi").select("pair_id") for s in ("left", "right")]
    return sides[0].unionByName(sides[1]).distinct()


def cascade_delete(tables: dict[str, DataFrame], doc_ids: DataFrame) -> dict[str, DataFrame]:
    """What remains of documents, chunks, embeddings, pairs, groups and details without these documents."""
    out = dict(tables)
    for name in ("documents", "chunks"):
        if name in tables:
            out[name] = tables[name].join(doc_ids, "doc_id", "left_anti")
    if "embeddings" in tables and "chunks" in tables:
        # a vector belongs to a text; it stays while any chunk has that text
        out["embeddings"] = tables["embeddings"].join(out["chunks"].select("text_hash").distinct(), "text_hash", "left_semi")
    if "pairs" in tables:
        out |= delete_pairs({k: v for k, v in tables.items() if k in ("pairs", "groups", "details")}, victims(tables["pairs"], doc_ids))
    return out


def delete_pairs(tables: dict[str, DataFrame], pair_ids: DataFrame) -> dict[str, DataFrame]:
    return {k: v.join(pair_ids.select("pair_id"), "pair_id", "left_anti") for k, v in tables.items() if "pair_id" in v.columns}


def delete_job(tables: dict[str, DataFrame], job_id: int) -> dict[str, DataFrame]:
    gone = tables["pairs"].where(F.col("job_id") == job_id).select("pair_id")
    out = delete_pairs(tables, gone)
    if "jobs" in tables:
        out["jobs"] = tables["jobs"].where(F.col("job_id") != job_id)
    return out


def project_job(jobs: DataFrame) -> DataFrame:
    """The oldest job of each project."""
    return jobs.groupBy("project_id").agg(F.min_by("job_id", F.struct("created_at", "job_id")).alias("job_id"))


def project_stats(docs: DataFrame, project: str = "project_id", jobs: DataFrame | None = None) -> DataFrame:
    """total, completed, pending (pending or processing) documents of each project, and its jobs where they are given."""
    out = docs.groupBy(project).agg(
        F.count("*").alias("total"), F.count_if(F.col("status") == "completed").alias("completed"), F.count_if(F.col("status").isin("pending", "processing")).alias("pending")
    )
    if jobs is None:
        return out
    return out.join(jobs.groupBy(project).agg(F.count("*").alias("jobs")), project, "left").withColumn("jobs", F.coalesce("jobs", F.lit(0)))


def document_summary(docs: DataFrame, detail: bool = False) -> DataFrame:
    """What a list of documents shows; with detail also the text and the metadata. Columns that docs lack are null."""
    names = ["doc_id", "project_id", "title", "filename", "source", "lang", "status", "paragraph_count", "sentence_count", "char_count", "created_at", "updated_at"]
    names += ["text", "metadata"] if detail else []
    return docs.select(*((F.col(n) if n in docs.columns else F.lit(None)).alias(n) for n in names))


def pair_summary(pairs: DataFrame) -> DataFrame:
    """What a list of pairs shows: ids, status and the metrics as one column."""
    metrics = F.struct("group_count", "top_score", "aggregate_alignment").alias("metrics")
    return pairs.select("pair_id", "job_id", "left_document_id", "right_document_id", "status", metrics)


def has_active_pairs(pairs: DataFrame, job: str = "job_id") -> DataFrame:
    return pairs.groupBy(job).agg(F.max(F.col("status").isin("pending", "running")).alias("active"))


def job_progress(events: DataFrame, job: str = "job_id", status: str = "status", at: str = "ts", done: tuple = ("completed", "failed", "skipped")) -> DataFrame:
    """Percent done, items per second and seconds left of each job, from its items' latest state."""
    finished = F.col(status).isin(*done)
    micros = lambda f: F.unix_micros(f(F.col(at).cast("timestamp")))
    seconds = (micros(F.max) - micros(F.min)) / 1e6
    out = events.groupBy(job).agg(F.count("*").alias("total"), F.count_if(finished).alias("done"), seconds.alias("seconds"))
    rate = F.when(F.col("seconds") > 0, F.col("done") / F.col("seconds"))
    return out.withColumns({"percent": F.round(100 * F.col("done") / F.col("total"), 2), "per_second": F.round(rate, 6), "seconds_left": F.when(rate > 0, F.round((F.col("total") - F.col("done")) / rate, 3))})


def latest_state(events: DataFrame, task: str, at: str = "ts") -> DataFrame:
    rest = [c for c in events.columns if c not in (task, at)]
    return events.groupBy(task).agg(F.max(at).alias(at), *(F.max_by(c, F.struct(at, *rest)).alias(c) for c in rest))


def purge_finished(events: DataFrame, hours: float, status: str = "status", at: str = "ts", done: tuple = ("completed", "failed", "cancelled")) -> DataFrame:
    """Without finished rows older than so many hours before the newest row."""
    newest = events.agg(F.max(at)).first()[0]
    old = F.col(at) < F.lit(newest) - F.make_dt_interval(hours=F.lit(int(hours)))
    return events if newest is None else events.where(~(F.col(status).isin(*done) & old))


def newest_first(df: DataFrame, at: str = "created_at") -> DataFrame:
    return df.orderBy(F.desc(at))


def recent(df: DataFrame, at: str, n: int = 50, *ties: str) -> DataFrame:
    return df.orderBy(F.desc(at), *ties).limit(n)


def page(df: DataFrame, order: list, limit: int, offset: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def apply_status(docs: DataFrame, updates: DataFrame, key: str = "doc_id") -> DataFrame:
    """updates: key, new_status, at, any of the other columns of docs. started_at is set the first time a row runs,
    completed_at when it ends; null updates leave a column as it is."""
    fields = [c for c in updates.columns if c not in (key, "new_status", "at")]
    u = updates.select(key, F.col("new_status").alias("_status"), F.col("at").alias("_at"), *(F.col(c).alias(f"_{c}") for c in fields))
    out = docs.join(u, key, "left").withColumn("status", F.coalesce("_status", "status"))
    if "started_at" in docs.columns:
        out = out.withColumn("started_at", F.when(F.col("_status").isin("running", "processing"), F.coalesce("started_at", "_at")).otherwise(F.col("started_at")))
    if "completed_at" in docs.columns:
        out = out.withColumn("completed_at", F.when(F.col("_status").isin("completed", "failed", "skipped"), F.col("_at")).otherwise(F.col("completed_at")))
    if "updated_at" in docs.columns:
        out = out.withColumn("updated_at", F.coalesce("_at", "updated_at"))
    return out.withColumns({c: F.coalesce(f"_{c}", c) for c in fields}).select(*docs.columns)
