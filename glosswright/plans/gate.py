"""The labelling gate: anchors are aligned with captions; what scores enough becomes a label, a verbatim part of the caption cut over the layout columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glosswright.functions import boxes as b
from glosswright.functions import text as t
from glosswright.functions.similarity import aligned
from glosswright.operators.relational import tallies
from glosswright.session import ship

THRESHOLD = 75.0
#: Names of fixes.
FIXES = ("dedup_columns", "strip_annot_brackets", "boundary_expand_variant", "strip_unbracketed_marker")


def cleaned(rows: DataFrame, kept: str = t.HAN, markers: bool = True, simplify: dict[str, str] | None = None) -> DataFrame:
    """``post_id, caption, reply`` with ``ocr`` (anchor lines), ``anchor`` and ``target`` (texts of the class), and both normalised."""
    rows = rows.withColumn("ocr", F.array_join(t.anchor_lines(F.col("reply")), "\n")).withColumn("anchor", t.keep_chars(F.col("ocr"), kept))
    target = t.strip_annotations(F.coalesce("caption", F.lit("")))
    if markers:
        target = t.strip_markers(target, F.col("anchor"))
    rows = rows.withColumn("target", t.keep_chars(target, kept))
    return rows.withColumn("anchor_n", t.normalise(F.col("anchor"), simplify)).withColumn("target_n", t.normalise(F.col("target"), simplify))


def gate(rows: DataFrame, threshold: float = THRESHOLD, kept: str = t.HAN, simplify: dict[str, str] | None = None, markers: bool = True) -> DataFrame:
    """One row per post of ``post_id, caption, reply, columns, signatures`` (box arrays): with ``status``, ``label``, ``leven_score``, ``lines``.

    Rows are read once. Nothing but the two texts reaches Python, and nulls for those of rows of which either is empty; the boxes of rejects aren't cleaned (``columns_clean`` is null).
    """
    ship(rows.sparkSession)
    rows = cleaned(rows, kept, markers, simplify)
    open_ = (F.col("anchor_n") != "") & (F.col("target") != "")
    out = rows.withColumn("a", aligned(*[F.when(open_, F.col(c)) for c in ("anchor_n", "target_n", "target")]))
    score, flat = F.coalesce("a.score", F.lit(0.0)), F.coalesce("a.label", F.lit(""))
    out = out.withColumn("leven_score", score).withColumn("flat", flat)
    passed = (F.col("leven_score") >= threshold) & (F.col("flat") != "")
    out = out.withColumn("status", F.when(passed, "SUCCESS").otherwise("REJECT"))
    out = out.withColumn("columns_clean", F.when(F.col("status") == "SUCCESS", b.clean_columns(F.col("columns"), F.col("signatures"))))
    heights = F.transform("columns_clean", lambda c: c["height"])
    out = out.withColumn("lines", F.when(F.col("status") == "SUCCESS", b.allocated_lines(F.col("flat"), heights)))
    return out.withColumn("label", F.array_join("lines", "\n")).withColumn("n_columns", F.size("lines")).drop("a", "flat", "anchor_n", "target_n")


def regate(samples: DataFrame, kept: str = t.HAN, simplify: dict[str, str] | None = None) -> DataFrame:
    """Aligns stored samples (``post_id, caption, ocr, label, leven_score, n_columns, columns, signatures``) anew, without markers and threshold.

    Samples whose normalised caption has another length keep label and score. The old values stay in ``*_v1``, those of the first pass if there are such.
    """
    new = gate(samples.select("post_id", "caption", F.col("ocr").alias("reply"), "columns", "signatures"), -1.0, kept, simplify, markers=False)
    new = new.select("post_id", F.col("label").alias("new_label"), F.col("leven_score").alias("new_score"), F.col("n_columns").alias("new_columns"))
    out = samples.join(new, "post_id", "left")
    for name, now in (("label", "new_label"), ("leven_score", "new_score"), ("n_columns", "new_columns")):
        old = F.coalesce(f"{name}_v1", name) if f"{name}_v1" in samples.columns else F.col(name)
        out = out.withColumn(f"{name}_v1", old).withColumn(name, F.coalesce(now, name)).drop(now)
    return out.withColumn("fixes_applied", F.array(*map(F.lit, FIXES[:3])))


def column_qa(rows: DataFrame, kept: str = t.HAN) -> DataFrame:
    """Counters of cleaning over ``columns, signatures, label, ocr``: posts, those whose columns changed, those with more columns than the reading has lines, and those with
    an orphan line, before and after."""
    flat = t.keep_chars(F.col("label"), kept)
    rows = rows.withColumn("clean_", b.clean_columns(F.col("columns"), F.col("signatures"))).withColumn("read_", F.size(t.line_counts(F.col("ocr"), kept)))
    cut = lambda boxes: b.has_orphan(b.allocated_lines(flat, F.transform(boxes, lambda c: c["height"])))
    rows = rows.withColumn("before_", cut("columns")).withColumn("after_", cut("clean_"))
    return tallies(
        rows,
        changed=F.size("columns") != F.size("clean_"),
        extra_before=(F.col("read_") > 0) & (F.size("columns") > F.col("read_")),
        extra_after=(F.col("read_") > 0) & (F.size("clean_") > F.col("read_")),
        orphan_before=F.col("before_"),
        orphan_after=F.col("after_"),
    )
