"""Change feeds: derive, decode, fold, apply, check.

A change log row is ``(change_id, change_type, table_name, before, after)`` with JSON images in text
(``schemas.CHANGE_LOG``). A decoded change is ``(change_id, op, table, id, before, after)``. Order
matters only within a key, so nothing here sorts the log as a whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tributary.functions import records, scalars

TWICE = "insert on a live key"
MOVED = "update changes the key"
MODES = ("off", "id", "before", "after", "full")


# ---- capture ---------------------------------------------------------------------------------------


def _image(side: str, columns: Sequence[str]) -> Column:
    return F.to_json(
        F.struct(*[F.col(f"{side}.{c}").alias(c) for c in columns]), {"ignoreNullFields": "false"}
    )


def capture_diff(
    old: DataFrame, new: DataFrame, key: str, table: str, mode: str = "full"
) -> DataFrame:
    """The changes that turn table version ``old`` into ``new``: ``(id, change_type, table_name, before, after)``.

    ``mode`` selects the images kept: both (``full``), one, none but the key (``id``), or no change
    rows at all (``off``). Rows equal in every column, NULLs included, are no change.
    """
    if mode not in MODES:
        raise ValueError(f"unknown capture mode {mode!r}; one of {MODES}")
    columns = new.columns
    joined = old.select(columns).alias("o").join(
        new.alias("n"), F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer"
    )
    same = F.lit(True)
    for c in columns:
        same &= F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}"))
    code = (
        F.when(F.col(f"o.{key}").isNull(), scalars.OP_CODES["insert"])
        .when(F.col(f"n.{key}").isNull(), scalars.OP_CODES["delete"])
        .otherwise(scalars.OP_CODES["update"])
    )
    nothing = F.lit(None).cast("string")
    before = F.when(F.col(f"o.{key}").isNotNull(), _image("o", columns))
    after = F.when(F.col(f"n.{key}").isNotNull(), _image("n", columns))
    changed = joined.filter(~same if mode != "off" else F.lit(False))
    return changed.select(
        F.coalesce(f"n.{key}", f"o.{key}").cast("string").alias("id"),
        code.alias("change_type"),
        F.lit(table).alias("table_name"),
        (before if mode in ("full", "before") else nothing).alias("before"),
        (after if mode in ("full", "after") else nothing).alias("after"),
    )


def capture_inserts(batch: DataFrame, version: int) -> DataFrame:
    """Shadow rows of an insert-only batch: every column of the row, its version and the operation."""
    return batch.select(
        F.lit(version).cast("bigint").alias("version"), F.lit("INSERT").alias("change_type"), "*"
    )


# ---- decode ----------------------------------------------------------------------------------------


def _examined(log: DataFrame, key: str) -> DataFrame:
    """The log with parsed images and, for an unusable row, the reason in ``skipped``."""
    parsed = records.computed_once(
        log.withColumn("op", scalars.op_name(F.col("change_type"))),
        {"_before": records.parsed(F.col("before")), "_after": records.parsed(F.col("after"))},
    )
    gone = F.col("op") == "delete"
    text = F.when(gone, F.col("before")).otherwise(F.col("after"))
    image = F.when(gone, F.col("_before")).otherwise(F.col("_after"))
    skipped = (
        F.when(F.col("op").isNull(), "unknown change type")
        .when(text.isNull(), "no row image")
        .when(image.isNull(), "image is not JSON")
    )
    path = f"$.{key}"
    return parsed.withColumns(
        {
            "skipped": skipped,
            "id": F.coalesce(records.text_at(image, path), F.lit("")),
            "before_id": records.text_at(F.col("_before"), path),
        }
    )


def decode(log: DataFrame, key: str = "id") -> DataFrame:
    """Usable changes. An image that is not JSON counts as absent; an image without a key has id ``''``."""
    kept = _examined(log, key).filter(F.col("skipped").isNull())
    return kept.select(
        "change_id",
        "op",
        F.col("table_name").alias("table"),
        "id",
        "before_id",
        F.when(F.col("_before").isNotNull(), F.col("before")).alias("before"),
        F.when(F.col("_after").isNotNull(), F.col("after")).alias("after"),
    )


def decode_strict(log: DataFrame, key: str = "id") -> DataFrame:
    """Like :func:`decode`, but an image that is present and not JSON fails the job."""
    image = F.when(F.col("change_type") == scalars.OP_CODES["delete"], F.col("before")).otherwise(F.col("after"))
    broken = scalars.op_name(F.col("change_type")).isNotNull() & image.isNotNull() & records.parsed(image).isNull()
    checked = F.when(
        broken,
        F.raise_error(F.concat(F.lit("change "), F.col("change_id"), F.lit(": image is not JSON"))).cast("int"),
    ).otherwise(F.col("change_type"))
    return decode(log.withColumn("change_type", checked), key)


def skipped_by_reason(log: DataFrame, key: str = "id") -> DataFrame:
    """How many log rows :func:`decode` leaves out, per reason."""
    return (
        _examined(log, key).filter(F.col("skipped").isNotNull())
        .groupBy(F.col("skipped").alias("reason")).agg(F.count(F.lit(1)).alias("c"))
    )


def op_counts(decoded: DataFrame) -> DataFrame:
    return decoded.groupBy("op").agg(F.count(F.lit(1)).alias("c"))


# ---- fold and apply --------------------------------------------------------------------------------


MOVE = "move"


def _touched(decoded: DataFrame, leave: bool) -> DataFrame:
    """``(id, change_id, op, image)``, one row per key a change touches; an update that moved here is a move."""
    image = F.when(F.col("op") == "delete", F.col("before")).otherwise(F.col("after"))
    moved = F.coalesce((F.col("op") == "update") & (F.col("before_id") != F.col("id")), F.lit(False))
    op = F.when(moved, MOVE).otherwise(F.col("op"))
    own = F.struct("id", op.alias("op"), image.alias("image"))
    if leave:
        return decoded.select("change_id", own.alias("e")).select("e.id", "change_id", "e.op", "e.image")
    left = F.struct(F.col("before_id").alias("id"), F.lit("delete").alias("op"), F.col("before").alias("image"))
    both = F.when(moved, F.array(left, own)).otherwise(F.array(own))
    return decoded.select("change_id", F.explode(both).alias("e")).select("e.id", "change_id", "e.op", "e.image")


def effects(decoded: DataFrame, leave: bool = True) -> DataFrame:
    """``(id, change_id, op, image)``. An update replaces the row under its new key.

    One that moved a row from another key leaves the old row; with ``leave=False`` it removes it.
    """
    op = F.when(F.col("op") == MOVE, "update").otherwise(F.col("op"))
    return _touched(decoded, leave).withColumn("op", op)


def touching(rows: DataFrame, keys: DataFrame, on: str | Sequence[str] = "id") -> DataFrame:
    """The ``rows`` whose key occurs in ``keys``: a large table is cut to a batch before it is joined with it."""
    on = [on] if isinstance(on, str) else list(on)
    return rows.join(keys.select(*on).distinct(), on, "left_semi")


def fold(changes: DataFrame, key: str = "id", order: str = "change_id") -> DataFrame:
    """The last row per key by ``order``. Each task reduces its rows per key before the one shuffle."""
    rest = [c for c in changes.columns if c != key]
    last = F.max_by(F.struct(*rest), F.col(order))
    return changes.groupBy(key).agg(last.alias("_last")).select(key, *[f"_last.{c}" for c in rest])


def live(folded: DataFrame) -> DataFrame:
    return folded.filter(F.col("op") != "delete")


def upsert_into(state: DataFrame, changes: DataFrame, key: str = "id", order: str = "change_id") -> DataFrame:
    """Newest row per key of ``state ∪ changes``, tombstones included: one fold over both, so one shuffle."""
    columns = state.columns
    return fold(state.unionByName(changes.select(columns)), key, order).select(columns)


def document_fields(doc: Column) -> list[Column]:
    """Text, meta and time of a parsed document image: absent or mistyped fields become ``''`` and 0."""
    return [
        F.coalesce(records.text_at(doc, "$.text"), F.lit("")).alias("text"),
        F.coalesce(records.text_at(doc, "$.meta"), F.lit("")).alias("meta"),
        F.coalesce(records.long_at(doc, "$.ts"), F.lit(0)).alias("ts"),
    ]


def document_rows(folded: DataFrame) -> DataFrame:
    """The live documents of a fold: ``(id, text, meta, ts)``."""
    parsed = live(folded).select("id", records.parsed(F.col("image")).alias("doc"))
    return parsed.select("id", *document_fields(F.col("doc")))


def document_state(effects: DataFrame) -> DataFrame:
    """Effects with the columns of a document instead of its image; none of a deleted one."""
    doc = F.when(F.col("op") != "delete", records.parsed(F.col("image")))
    parsed = effects.select("id", "change_id", "op", doc.alias("doc"))
    return parsed.select("id", "change_id", "op", *document_fields(F.col("doc")))


def patent_state(effects: DataFrame) -> DataFrame:
    """Effects with the nine patent columns instead of the image."""
    image = F.when(F.col("op") != "delete", F.col("image"))
    return typed_image(effects.withColumn("image", image), "image", PATENT_TEXTS, PATENT_INTS)


def typed_image(images: DataFrame, image: str, texts: Sequence[str], ints: Sequence[str]) -> DataFrame:
    """Columns read from a JSON image: text fields must be strings, number fields 32-bit integers."""
    doc = F.col("_doc")
    parsed = images.withColumn("_doc", records.parsed(F.col(image)))
    columns = {name: records.text_at(doc, f"$.{name}") for name in texts}
    columns |= {name: records.int_at(doc, f"$.{name}") for name in ints}
    return parsed.withColumns(columns).drop("_doc", image)


PATENT_TEXTS = ("patent_id", "title", "abstract", "assignee", "grant_date")
PATENT_INTS = ("grant_year", "claims_len", "n_cpc", "n_citations")


def patent_rows(images: DataFrame, image: str = "image") -> DataFrame:
    """The nine patent columns of a JSON image."""
    return typed_image(images.select(image), image, PATENT_TEXTS, PATENT_INTS)


# ---- checks ----------------------------------------------------------------------------------------


def with_previous(
    df: DataFrame, key: str, order: str, value: str, name: str = "previous", width: int = 1_000_000
) -> DataFrame:
    """Adds the ``value`` of the row before, by integer ``order`` within ``key``.

    A key may own most of the rows, so no window spans a whole key. Rows are windowed per stretch of
    ``width`` order values; the first row of a stretch takes its value from a summary that has one row
    per key and stretch.
    """
    rows = df.withColumn("_stretch", F.floor(F.col(order) / width))
    inside = Window.partitionBy(key, "_stretch").orderBy(order)
    across = Window.partitionBy(key).orderBy("_stretch")
    # The last value of each stretch needs no order of the rows, only their maximum.
    tails = rows.groupBy(key, "_stretch").agg(F.max_by(value, order).alias("_tail"))
    tails = tails.select(key, "_stretch", F.lag("_tail").over(across).alias("_carried"))
    return (
        rows.withColumns({"_before": F.lag(value).over(inside), "_first": F.row_number().over(inside) == 1})
        .join(tails, [key, "_stretch"])
        .withColumn(name, F.when(F.col("_first"), F.col("_carried")).otherwise(F.col("_before")))
        .drop("_stretch", "_before", "_first", "_carried")
    )


def violations(
    decoded: DataFrame, existing: DataFrame | None = None, width: int = 1_000_000, leave: bool = True
) -> DataFrame:
    """Changes to look at in a strict table: an insert on a live key, which it refuses, and an update that moves a row's key.

    ``existing`` holds the keys (column ``id``) that are live before the first change.
    """
    touched = _touched(decoded, leave).drop("image")
    chained = with_previous(touched, "id", "change_id", "op", width=width)
    if existing is not None:
        known = touching(existing.select("id"), touched).distinct().withColumn("_known", F.lit(True))
        chained = chained.join(known, "id", "left")
    else:
        chained = chained.withColumn("_known", F.lit(False))
    was_live = F.when(F.col("previous").isNull(), F.coalesce("_known", F.lit(False))).otherwise(
        F.col("previous") != "delete"
    )
    reason = F.when((F.col("op") == "insert") & was_live, TWICE).when(F.col("op") == MOVE, MOVED)
    return chained.select("id", "change_id", reason.alias("reason")).filter(F.col("reason").isNotNull())


def content_hash(df: DataFrame) -> DataFrame:
    """One row ``(rows, xor_hash, sum_hash)``, independent of row order. One pass, no row is shuffled."""
    row = F.xxhash64(*[F.col(c) for c in sorted(df.columns)])
    return df.select(row.alias("h")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.bit_xor("h"), F.lit(0).cast("bigint")).alias("xor_hash"),
        F.coalesce(F.sum(F.col("h").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias("sum_hash"),
    )


def same_content(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: the row counts of both tables, and whether they hold the same rows."""
    right = content_hash(b.select(a.columns)).select(F.struct("rows", "xor_hash", "sum_hash").alias("r"))
    both = content_hash(a).withColumn("right", right.scalar())
    equal = F.lit(True)
    for c in ("rows", "xor_hash", "sum_hash"):
        equal &= F.col(c) == F.col(f"right.{c}")
    return both.select(
        F.col("rows").alias("left_rows"), F.col("right.rows").alias("right_rows"), equal.alias("consistent")
    )


def lake_rows(decoded: DataFrame) -> DataFrame:
    """The append-only view: every insert and update image, deletes not applied."""
    return decoded.filter(F.col("op") != "delete").select("change_id", "op", "id", F.col("after").alias("image"))


def remaining(log: DataFrame, cursor: int | None) -> DataFrame:
    """What is left of a log pruned up to ``cursor``; nothing when no cursor is given."""
    return log.filter(F.lit(False) if cursor is None else F.col("change_id") > cursor)


def change_events(decoded: DataFrame) -> DataFrame:
    """One JSON event per change, images embedded as objects: ``{op,table,id,after,before}``."""
    event = F.struct(
        "op", "table", "id", F.parse_json("after").alias("after"), F.parse_json("before").alias("before")
    )
    return decoded.select("change_id", "id", F.to_json(event, {"ignoreNullFields": "false"}).alias("value"))
