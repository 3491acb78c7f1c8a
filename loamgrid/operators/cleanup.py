"""Clean-up of small components: eligibility, targets, application."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def reasons(parts: DataFrame, policy: DataFrame) -> DataFrame:
    """Adds reason: why a component is kept, null if it may be absorbed.

    ``policy``: class_index, threshold, protected. Rules in order: size, protected class, border contact, elongation.
    """
    rows = parts.join(F.broadcast(policy), "class_index", "left")
    w, h = F.col("x1") - F.col("x0") + 1, F.col("y1") - F.col("y0") + 1
    long = (F.col("pixel_count") >= 3) & (F.greatest(w, h) / F.least(w, h) >= 3) & (F.col("pixel_count") / F.greatest(w, h) <= 1.5)
    reason = F.when(F.col("threshold").isNull() | (F.col("threshold") <= 0) | (F.col("pixel_count") >= F.col("threshold")), "outside_threshold").when(F.col("protected"), "protected_class")
    return rows.withColumn("reason", reason.when(F.col("touches_border"), "touches_processing_border").when(long, "elongated_component"))


def candidates(judged: DataFrame, contacts: DataFrame, rules: DataFrame | None = None, bypass: int = 0) -> DataFrame:
    """Contacts of absorbable components with unprotected neighbours of another class that are larger (ties: the smaller id).

    ``rules`` (class_index, other_class_index, compatible, disallowed; a row for each pair of classes) takes out disallowed
    targets, and incompatible ones for components of ``bypass`` pixels or more.
    """
    info = judged.select(F.col("component_id").alias("other_component_id"), F.col("pixel_count").alias("other_pixels"), F.col("protected").alias("other_protected"))
    rows = judged.where("reason is null").select("component_id", "pixel_count").join(contacts, "component_id").join(info, "other_component_id")
    larger = (F.col("other_pixels") > F.col("pixel_count")) | ((F.col("other_pixels") == F.col("pixel_count")) & (F.col("other_component_id") < F.col("component_id")))
    rows = rows.where((F.col("class_index") != F.col("other_class_index")) & ~F.coalesce("other_protected", F.lit(False)) & larger)
    if rules is None:
        return rows
    met = rows.join(F.broadcast(rules), ["class_index", "other_class_index"], "left")  # pairs of classes
    fits = ~F.coalesce("disallowed", F.lit(False)) & (F.coalesce("compatible", F.lit(True)) | (F.col("pixel_count") < bypass))
    return met.where(fits).drop("compatible", "disallowed")


def mean_probabilities(pixels: DataFrame, classes: int) -> DataFrame:
    """component_id, means: mean probability of each class over the component's pixels (column ``probs``)."""
    sums = pixels.groupBy("component_id").agg(*[F.avg(F.get("probs", F.lit(k))).alias(f"p{k}") for k in range(classes)])
    return sums.select("component_id", F.array(*[f"p{k}" for k in range(classes)]).alias("means"))


def confident(found: DataFrame, confidence: DataFrame, hard: int, sure: float) -> DataFrame:
    """component_id of components that have a candidate, ``hard`` pixels or more, and a mean confidence over ``sure``."""
    held = found.where(F.col("pixel_count") >= hard).select("component_id").distinct()
    return held.join(confidence.where(F.round("confidence", 9) > sure), "component_id", "left_semi")


def targets(found: DataFrame, means: DataFrame | None = None, share_weight: float = 1.0, p_weight: float = 0.0, drop: float | None = None, hard: int = 0, confidence: DataFrame | None = None, sure: float = 1.0) -> DataFrame:
    """component_id, class_index, pixel_count, target_class, target_id, share, p, own_p of each component's target.

    The class with the best weighted sum of contact share and mean probability (ties: larger contact, then the lower class), in it the
    component with the largest contact, then size, then lower id. With ``drop``, a component of ``hard`` pixels or more whose target is
    less probable than its own class by more than that stays. Without ``means`` probabilities count as zero; then ``confidence``
    (component_id, confidence: the mean over its pixels) may keep a component of ``hard`` pixels or more whose mean is over ``sure``.
    """
    if means is None and confidence is not None:
        found = found.join(confident(found, confidence, hard, sure), "component_id", "left_anti")
    whole, cls = W.partitionBy("component_id"), W.partitionBy("component_id", "other_class_index")
    scored = found.withColumn("class_contact", F.sum("contact").over(cls)).withColumn("share", F.col("class_contact") / F.sum("contact").over(whole))
    if means is None:
        scored = scored.withColumns({"p": F.lit(0.0), "own_p": F.lit(0.0)})
    else:
        scored = scored.join(means, "component_id", "left").withColumns({"p": F.get("means", F.col("other_class_index").cast("int")), "own_p": F.get("means", F.col("class_index").cast("int"))})
    score = F.round(share_weight * F.col("share") + p_weight * F.col("p"), 9)
    order = whole.orderBy(score.desc(), F.col("class_contact").desc(), "other_class_index", F.col("contact").desc(), F.col("other_pixels").desc(), "other_component_id")
    first = scored.withColumn("n", F.row_number().over(order)).where("n = 1")
    if drop is not None:
        first = first.where((F.col("pixel_count") < hard) | (F.round("p", 9) >= F.round(F.col("own_p") - drop, 9)))
    return first.select("component_id", "class_index", "pixel_count", F.col("other_class_index").alias("target_class"), F.col("other_component_id").alias("target_id"), "share", "p", "own_p")


def audit(before: DataFrame, after: DataFrame, limit: int, protected: Column) -> DataFrame:
    """What a clean-up changed, for each class. ``after``: x, y, was, class_index; components touch at sides or corners, fragments have under ``limit`` pixels."""
    from loamgrid.operators import contacts
    from loamgrid.operators import rasters as R
    from loamgrid.sources.scratch import saved

    after = saved(after, "after")

    def shapes(pixels: DataFrame, name: str) -> DataFrame:
        parts = pixels.groupBy("component_id", "class_index").agg(F.count("*").alias("n")).groupBy("class_index")
        return parts.agg(F.count("*").alias(f"components_{name}"), F.count_if(F.col("n") < limit).alias(f"fragments_{name}"))

    one = F.when(F.col("was") != F.col("class_index"), 1).otherwise(0)
    sides = F.array(F.struct(F.col("was").alias("c"), F.lit(1).alias("b"), F.lit(0).alias("a"), one.alias("o"), F.lit(0).alias("i")), F.struct(F.col("class_index").alias("c"), F.lit(0).alias("b"), F.lit(1).alias("a"), F.lit(0).alias("o"), one.alias("i")))
    flow = after.select(F.explode(sides).alias("s")).groupBy(F.col("s.c").alias("class_index")).agg(F.sum("s.b").alias("before"), F.sum("s.a").alias("after"), F.sum("s.o").alias("loss"), F.sum("s.i").alias("gain"))
    rows = flow.withColumn("drift", F.col("after") - F.col("before"))
    for name, pixels, labels in (("before", before, before), ("after", R.with_components(after.drop("was"), diagonal=True), after)):
        rows = rows.join(shapes(pixels, name), "class_index", "left")
        rows = rows.join(contacts.boundary_lengths(labels.select("x", "y", "class_index")).select("class_index", F.col("internal").alias(f"boundary_{name}")), "class_index", "left")
    counts = [f"{c}_{n}" for c in ("components", "fragments", "boundary") for n in ("before", "after")]
    rows = rows.fillna(0, counts).withColumn("protected_loss", F.when(protected, F.col("loss")).otherwise(0))
    total = lambda c: F.sum(c).over(W.partitionBy())  # noqa: E731  a row for each class
    passed = (total("protected_loss") == 0)
    for c in ("components", "fragments", "boundary"):
        passed = passed & (total(f"{c}_after") <= total(f"{c}_before"))
    return rows.select("class_index", "before", "after", "drift", "loss", "gain", *counts, "protected_loss", passed.alias("passed"))


def roots(decisions: DataFrame, rounds: int = 40) -> DataFrame:
    """component_id, root_id: the end of each chain of targets, by pointer jumping (a few rounds: chains double each time)."""
    from loamgrid.sources.scratch import saved

    now = saved(decisions.select("component_id", F.col("target_id").alias("root_id")), "roots")
    for _ in range(rounds):
        ahead = now.select(F.col("component_id").alias("root_id"), F.col("root_id").alias("next_id"))
        if not now.join(ahead, "root_id", "left_semi").head(1):
            break
        now = saved(now.join(ahead, "root_id", "left").select("component_id", F.coalesce("next_id", "root_id").alias("root_id")), "roots")
    return now


def apply(pixels: DataFrame, ends: DataFrame, parts: DataFrame) -> DataFrame:
    """Pixels with the class of the component that absorbs theirs."""
    new = ends.join(parts.select(F.col("component_id").alias("root_id"), F.col("class_index").alias("new_class")), "root_id").select("component_id", "new_class")
    return pixels.join(new, "component_id", "left").withColumn("class_index", F.coalesce("new_class", "class_index")).drop("new_class")


def _within_budgets(loss: float, gain: float, remaining: int):
    """Decisions of one owner partition in ascending size; one that breaks a budget is skipped, later smaller ones are not."""

    def run(rows):
        rows = rows.sort_values(["pixel_count", "class_index", "component_id"])
        lost: dict[int, int] = {}
        won: dict[int, int] = {}
        reasons = []
        for r in rows.itertuples(index=False):
            out, into = lost.get(r.class_index, 0) + r.pixel_count, won.get(r.target_class, 0) + r.pixel_count
            if out > loss * r.source_total:
                reasons.append("source_class_loss_budget")
            elif r.source_total - out < remaining:
                reasons.append("source_class_minimum_area")
            elif into > gain * r.target_total:
                reasons.append("target_class_gain_budget")
            else:
                reasons.append("accepted")
                lost[r.class_index], won[r.target_class] = out, into
        return rows[["owner", "component_id"]].assign(outcome=reasons)

    return run


def budgeted(decisions: DataFrame, totals: DataFrame, loss: float, gain: float, remaining: int = 0) -> DataFrame:
    """owner, component_id, outcome of decisions (with ``owner``) under the class budgets of their owner partition.

    A decision may not take more than ``loss`` of its class's pixels with those before it, leave fewer than ``remaining``, or
    let the target class grow by more than ``gain``.  ``totals``: owner, class_index, pixels. A partition's decisions meet in one group; a partition is a window of fixed size.
    """
    source = totals.select("owner", "class_index", F.col("pixels").alias("source_total"))
    target = totals.select("owner", F.col("class_index").alias("target_class"), F.col("pixels").alias("target_total"))
    rows = decisions.join(source, ["owner", "class_index"], "left").join(target, ["owner", "target_class"], "left").fillna(0, ["source_total", "target_total"])
    return rows.groupBy("owner").applyInPandas(_within_budgets(loss, gain, remaining), "owner long, component_id long, outcome string")


def boundary_delta(chosen: DataFrame, contacts: DataFrame) -> DataFrame:
    """component_id, delta: sides of boundary that go when a component takes its target's class (4-neighbour contacts)."""
    met = contacts.select("component_id", F.col("other_class_index").alias("target_class"), "contact")
    gone = chosen.join(met, ["component_id", "target_class"], "left").groupBy("component_id").agg(F.coalesce(F.sum("contact"), F.lit(0)).alias("gone"))
    return gone.select("component_id", (-F.col("gone")).alias("delta"))


def explain(judged: DataFrame, found: DataFrame, chosen: DataFrame) -> DataFrame:
    """component_id, place, gate, passed: every gate of a component in order; a gate after a failed one isn't asked."""
    gates = ("outside_threshold", "protected_class", "touches_processing_border", "elongated_component", "no_larger_neighbor", "probability_drop")
    rows = judged.select("component_id", "reason").join(chosen.select("component_id", F.lit(True).alias("chosen")), "component_id", "left")
    rows = rows.join(found.select("component_id", F.lit(True).alias("found")).distinct(), "component_id", "left")
    failed = F.coalesce("reason", F.when(F.col("found").isNull(), gates[-2]), F.when(F.col("chosen").isNull(), gates[-1]))
    stop = F.coalesce(F.array_position(F.array(*map(F.lit, gates)), failed), F.lit(len(gates)))
    asked = F.transform(F.slice(F.array(*map(F.lit, gates)), F.lit(1), stop.cast("int")), lambda g, i: F.struct((i + 1).alias("place"), g.alias("gate"), (~g.eqNullSafe(failed)).alias("passed")))
    return rows.select("component_id", F.explode(asked).alias("g")).select("component_id", "g.place", "g.gate", "g.passed")
