"""Cohorts and scan inventories: selection, matching in time and by name, completeness, logs."""

from __future__ import annotations

import math
from collections.abc import Sequence
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from voxframe.sources.shared import cut

CLOSE = 0.8
#: Least ratios of the passes of block_match; names in one group of a join, at most about.
PASSES, GROUP = (0.9, 0.75), 1000


def select_channels(inventory: DataFrame, prefixes: Sequence[str], both_of: str = "TRACE") -> DataFrame:
    """subject, modality, prefix, nth, study: the study that starts with each prefix, in the prefixes' order; a prefix with `both_of` gets its first two by lower-cased name. `problem` marks prefixes with more studies than that."""
    wanted = F.explode(F.array(*[F.struct(F.lit(i).alias("position"), F.lit(p).alias("prefix")) for i, p in enumerate(prefixes)]))
    hits = inventory.select("subject", "modality", "study", wanted.alias("w")).filter(F.startswith("study", "w.prefix"))
    by_name = Window.partitionBy("subject", "modality", "w.position").orderBy(F.lower("study"), "study")
    most = F.when(F.col("w.prefix").contains(both_of), 2).otherwise(1)
    ranked = hits.withColumn("nth", F.row_number().over(by_name)).withColumn("found", F.count("*").over(Window.partitionBy("subject", "modality", "w.position")))
    return ranked.filter(F.col("nth") <= most).select("subject", "modality", F.col("w.position").alias("position"), F.col("w.prefix").alias("prefix"), "nth", "study", (F.col("found") > most).alias("problem"))


def completeness(inventory: DataFrame, keys: Sequence[str], wanted: Sequence[str], column: str = "study") -> DataFrame:
    """keys, a 0/1 column has_<name> per wanted name (contained in the study's), complete, and the missing names."""
    flags = inventory.groupBy(*keys).agg(*[F.max(F.when(F.col(column).contains(w), 1).otherwise(0)).alias(f"has_{w}") for w in wanted])
    missing = F.array_join(F.array_compact(F.array(*[F.when(F.col(f"has_{w}") == 0, w) for w in wanted])), ",")
    return flags.withColumn("missing", missing).withColumn("complete", F.when(F.col("missing") == "", 1).otherwise(0))


def first_after(anchors: DataFrame, candidates: DataFrame) -> DataFrame:
    """anchors (subject, ts) with the candidate (subject, ts, kind, has_label, complete) chosen for each: of those at or after the anchor one with a label, else a complete one, the earliest first; `several` flags a choice among more. Anchors without one are left out.

    One shuffle by subject; a subject's events are its own few, so the range condition stays inside small groups.
    """
    c = candidates.select("subject", F.col("ts").alias("c_ts"), "kind", "has_label", "complete")
    usable = anchors.join(c, "subject").filter((F.col("c_ts") >= F.col("ts")) & (F.col("has_label") | F.col("complete")))
    best = usable.groupBy("subject", "ts").agg(F.min(F.struct((~F.col("has_label")).alias("o"), "c_ts", "kind")).alias("b"), F.count("*").alias("n"))
    return best.select("subject", "ts", F.col("b.c_ts").alias("chosen_ts"), F.col("b.kind").alias("kind"), (F.col("n") > 1).alias("several"))


def numbered_grams(text: Column, q: int) -> Column:
    """The text's q-grams as structs g, m; m counts equal ones, so that repeated grams differ."""
    grams = F.when(F.length(text) >= q, F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - (q - 1), F.lit(1))), lambda i: F.substring(text, i, F.lit(q)))).otherwise(F.array().cast("array<string>"))
    return F.transform(grams, lambda g, i: F.struct(g.alias("g"), F.size(F.filter(F.slice(grams, F.lit(1), i + 1), lambda x: x == g)).alias("m")))


def similar_names(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """a, b, ratio: all pairs of the distinct names left.a and right.b with 1 - edit distance / longer length over `least`.

    Each edit spoils at most q of a name's q-grams, so names within d edits share one of the q * d + 1 rarest of each, as
    long as the longer has more than q * d grams: pairs if it is long enough for `least`, else single letters.
    """
    long = math.ceil(2 / (2 * least - 1) + 1e-9) if least > 0.5 else None
    most = lambda q, n: q * F.floor(n * ((1 - least) / least) + 1e-9).cast("int") + 1 if least > 0 else n
    longer = lambda a, b: F.greatest(F.length(a), F.length(b))
    found = None
    for q in (1, 2) if long else (1,):
        sides = []
        for df, c in ((left, "a"), (right, "b")):
            n = F.length(c)
            takes_part = F.lit(True) if not long else n < long if q == 1 else n >= math.floor(long * least)
            sides.append(df.filter(takes_part).select(c, F.inline(numbered_grams(F.col(c), q))))
        often = sides[0].select("g", "m").unionByName(sides[1].select("g", "m")).groupBy("g", "m").agg(F.count("*").alias("n"))
        rare = [s.join(often, ["g", "m"]).groupBy(c).agg(F.sort_array(F.collect_list(F.struct("n", "g", "m"))).alias("all")).select(c, F.inline(F.slice("all", F.lit(1), most(q, F.length(c))))).drop("n") for s, c in zip(sides, "ab", strict=True)]
        fits = F.least(F.length("a"), F.length("b")) >= longer("a", "b") * least - 1e-9
        if long:
            fits = fits & (longer("a", "b") < long if q == 1 else longer("a", "b") >= long)
        pairs = rare[0].join(rare[1], ["g", "m"]).filter(fits).select("a", "b").distinct()
        found = pairs if found is None else found.unionByName(pairs)
    return found.withColumn("ratio", 1 - F.try_divide(F.levenshtein("a", "b"), longer("a", "b"))).filter(F.col("ratio") > least)


def fuzzy_match(left: DataFrame, right: DataFrame, name: str = "name", least: float = 0.6) -> DataFrame:
    """left's name with the most similar right name over `least`: 1 - edit distance / longer length, ties to the smaller name; exact over all pairs. Empty names match nothing.

    Names with a match over CLOSE are done after a first pass, which few rare grams decide; only the others are searched down to `least`.
    """
    r = right.select(F.col(name).alias("b")).distinct()

    def best(names: DataFrame, over: float) -> DataFrame:
        m = similar_names(names, r, over).groupBy("a").agg(F.min(F.struct((-F.col("ratio")).alias("r"), "b")).alias("m"))
        return m.select("a", F.col("m.b").alias("b"), (-F.col("m.r")).alias("ratio"))

    l = left.select(F.col(name).alias("a")).distinct()  # noqa: E741
    if least >= CLOSE:
        return best(l, least)
    close = best(l, CLOSE)
    return close.unionByName(best(l.join(close, "a", "left_anti"), least))


@F.pandas_udf(DoubleType())
def block_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the letters in matching blocks over all letters: the longest common block first, then the same on its left and right."""
    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def sharing_names(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """a, b: the pairs of distinct names left.a and right.b, not empty, that share enough letters (with repeats) for a block ratio of `least`.

    A pair of ratio t shares t (la + lb) / 2 letters, so each name of n letters shares at least s = ceil(n t / (2 - t)) of
    them. Then two of the n - s + 2 rarest letters of each are common: names meet by pairs of those, or by single letters
    where a name is so short that one common letter does. Groups of over 1000 names are split on both sides.
    """
    tokens, taken = F.transform(numbered_grams(F.col("name"), 1), lambda s: F.concat(s["g"], s["m"].cast("string"))), F.col("n") - F.ceil(F.col("n") * (least / (2 - least)) - 1e-9)
    both = left.select(F.lit(True).alias("of_left"), F.col("a").alias("name")).unionByName(right.select(F.lit(False).alias("of_left"), F.col("b").alias("name")))
    names = both.filter("name <> ''").withColumns({"n": F.length("name"), "tokens": tokens})
    often = names.select(F.explode("tokens").alias("t")).groupBy("t").agg(F.count("*").alias("c"))
    # Letters times their most repeats in a name; ranks go by count, ties by letter.
    ranked = names.select("of_left", "name", "n", "tokens", F.explode("tokens").alias("t")).join(often, "t").groupBy("of_left", "name", "n", "tokens").agg(F.sort_array(F.collect_list(F.struct("c", "t"))).alias("by"))
    rare = cut(ranked.withColumn("rare", F.slice(F.transform("by", lambda s: s["t"]), F.lit(1), F.least(F.col("n"), taken + 2).cast("int"))).drop("by"))  # read for both sides and their counts
    short = math.floor((2 - least) / least + 1e-9)  # longest name of which one common letter may be enough
    near = math.floor(short * (2 - least) / least + 1e-9)
    pairs = F.flatten(F.transform("rare", lambda x, i: F.transform(F.slice("rare", i + 2, F.size("rare")), lambda y: F.concat_ws(" ", x, y))))
    keyed = rare.filter(F.col("n") > short).withColumn("key", F.explode(pairs)).unionByName(rare.filter(F.col("n") <= near).withColumn("key", F.explode("rare")))
    sides = [keyed.filter(F.col("of_left") == of).select("key", F.col("name").alias(c), F.col("n").alias(f"n_{c}"), F.col("tokens").alias(f"t_{c}")) for c, of in (("a", True), ("b", False))]
    parts = [s.groupBy("key").agg(F.ceil(F.count("*") / GROUP).cast("int").alias(f"p_{c}")) for c, s in zip("ab", sides, strict=True)]
    parts = parts[0].join(parts[1], "key")
    a, b = (s.join(parts, "key").withColumns({f"s_{c}": F.pmod(F.xxhash64(c), F.col(f"p_{c}")).cast("int"), f"s_{d}": F.explode(F.sequence(F.lit(0), F.col(f"p_{d}") - 1))}).drop("p_a", "p_b") for c, d, s in zip("ab", "ba", sides, strict=True))
    total, low = F.col("n_a") + F.col("n_b"), F.least("n_a", "n_b")
    met = a.join(b, ["key", "s_a", "s_b"]).filter(2 * low >= least * total - 1e-9).filter(2 * F.size(F.array_intersect("t_a", "t_b")) >= least * total - 1e-9)
    return met.select("a", "b").distinct()


def block_match(left: DataFrame, right: DataFrame, name: str = "name", least: float = 0.6) -> DataFrame:
    """a, b, ratio: each distinct left name with the right name whose matching blocks cover most, if at least `least`; ties to the larger name, exact over all pairs.

    The choice goes by the ratio of (right, left), the result is that of (left, right); they rarely differ. Null and empty
    names match nothing; repeated names count once. Names that have a match in a strict pass, where few rare letters decide,
    are done; only the others are searched further down. Distinct names are written first, since each pass reads them many
    times: beyond that, work goes by distinct names and not by rows.
    """
    if not 0 < least <= 1:
        raise ValueError("least must be over 0 and at most 1")
    names = lambda df, c: cut(df.select(F.col(name).alias(c)).filter(F.col(c) != "").distinct())
    r, rest = names(right, "b"), names(left, "a")
    done = None
    for step in [*(s for s in PASSES if s > least), least]:
        if done is not None and rest.isEmpty():
            break
        scored = sharing_names(rest, r, step).withColumn("r", block_ratio("b", "a")).filter(F.col("r") >= step)
        best = scored.groupBy("a").agg(F.max(F.struct("r", "b")).alias("m")).select("a", F.col("m.b").alias("b"))
        best = cut(best.withColumn("ratio", block_ratio("a", "b")))
        done = best if done is None else done.unionByName(best)
        rest = cut(rest.join(best, "a", "left_anti"))
    return done


def cohort_filter(subjects: DataFrame, clinical: DataFrame, treated_before: Column) -> DataFrame:
    """subject, included, reason: left out if treated before imaging or not in the clinical table."""
    c = clinical.select("subject", treated_before.alias("__early"))
    reason = F.when(F.col("__early").isNull(), "not found").when(F.col("__early"), "treated before")
    return subjects.join(c, "subject", "left").select("subject", reason.isNull().alias("included"), reason.alias("reason"))


def status_split(subjects: DataFrame, status: DataFrame, column: str, names: dict[str, str], otherwise: str) -> DataFrame:
    """subject, group of those in both tables; of repeated status rows the first by value counts."""
    first = status.groupBy("subject").agg(F.min(column).alias("__s"))
    group = F.lit(otherwise)
    for value, name in names.items():
        group = F.when(F.col("__s") == value, name).otherwise(group)
    return subjects.join(first, "subject").select("subject", group.alias("grp"))


def route_series(series: DataFrame, groups: DataFrame, keys: Sequence[str]) -> DataFrame:
    """series with `target`: the group with the same keys (the smallest name of several), else a new one named from the first two keys."""
    known = groups.groupBy(*keys).agg(F.min("grp").alias("__g"))
    return series.join(known, list(keys), "left").withColumn("target", F.coalesce("__g", F.concat_ws("_", *[F.col(k).cast("string") for k in keys[:2]]))).drop("__g")


def presence_log(subjects: DataFrame, inventory: DataFrame, prefixes: Sequence[str], done: DataFrame) -> DataFrame:
    """subject, prefix, n, level: `exclude` where no study starts with the prefix, `warning` where several do; subjects already done are skipped."""
    wanted = subjects.join(done, "subject", "left_anti").withColumn("prefix", F.explode(F.array(*map(F.lit, prefixes))))
    hits = inventory.select("subject", "study")
    counts = wanted.join(hits, "subject", "left").groupBy("subject", "prefix").agg(F.sum(F.when(F.startswith("study", "prefix"), 1).otherwise(0)).alias("n"))
    return counts.filter("n <> 1").withColumn("level", F.when(F.col("n") == 0, "exclude").otherwise("warning"))


def dedupe(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The first row of each key by `order`, and all rows of keys that occur more than once."""
    first = df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__n = 1").drop("__n")
    repeated = df.groupBy(*keys).count().filter("count > 1").drop("count")
    return first, df.join(repeated, list(keys), "left_semi")


def unique_path(df: DataFrame, parent: str, name: str, order: Sequence[str]) -> DataFrame:
    """`target`: the name for the first that has it, otherwise with its parent in front."""
    n = F.row_number().over(Window.partitionBy(name).orderBy(*order))
    return df.withColumn("target", F.when(n == 1, F.col(name)).otherwise(F.concat_ws("_", parent, name)))


#: The series that each kind of dataset is made of, in channel order; without the first w (or _w) they are in patient space.
SEQUENCES = {
    "perfusion": ("wcoreg_Tmax", "wcoreg_CBF", "wcoreg_MTT", "wcoreg_CBV"),
    "vessels": ("wmask_filtered_extracted_betted_Angio",),
    "4d": ("wp_VPCT",),
    "angio": ("wbetted_Angio",),
    "mri": ("wcoreg_t2_tse_tra", "wcoreg_t2_TRACE", "wcoreg_t2_ADC"),
}
LABELS = {"perfusion": "masked_wcoreg_VOI"}
OTHER_LABEL = "wcoreg_VOI"


def sequences_of(mode: str, high_resolution: bool = False) -> tuple[tuple[str, ...], str]:
    """The series of a mode and the series of its label. ValueError for an unknown mode."""
    if mode not in SEQUENCES:
        raise ValueError(f"unknown mode {mode}; one of {', '.join(SEQUENCES)}")
    names, label = SEQUENCES[mode], LABELS.get(mode, OTHER_LABEL)
    if high_resolution:
        return tuple(n.removeprefix("w") for n in names), label.removeprefix("w").replace("_w", "_")
    return names, label


def choose_sequences(inventory: DataFrame, wanted: Sequence[str], label: str | None = None) -> DataFrame:
    """subject, modality, position, prefix, study: of the subjects that have every wanted series (and the label's, in last place), the first study of each in its first modality."""
    names = [*wanted, *([label] if label else [])]
    first = Window.partitionBy("subject", "position").orderBy("modality")
    chosen = select_channels(inventory, names).filter("nth = 1").withColumn("__n", F.row_number().over(first)).filter("__n = 1")
    whole = chosen.groupBy("subject").agg(F.count("*").alias("__n")).filter(F.col("__n") == len(names))
    return chosen.join(whole.select("subject"), "subject", "left_semi").select("subject", "modality", "position", "prefix", "study")


def build_dataset(tables: dict[str, DataFrame], clinical: DataFrame, treated_before: Column, wanted: DataFrame | None = None) -> dict[str, DataFrame]:
    """Every table with its subjects cut to the included ones (in the clinical table, not treated before, and with all wanted series), and the clinical table likewise."""
    first, *others = tables.values()
    subjects = first.select("subject").distinct()
    for t in others:
        subjects = subjects.join(t.select("subject"), "subject", "left_semi")
    if wanted is not None:
        subjects = subjects.join(wanted.select("subject"), "subject", "left_semi")
    kept = cohort_filter(subjects, clinical, treated_before).filter("included").select("subject")
    return {n: t.join(kept, "subject", "left_semi") for n, t in (tables | {"clinical": clinical}).items()}


def any_row(condition: Column, name: str) -> Column:
    """1 if the condition holds for a row of the group, else 0; nulls don't count."""
    return F.max(F.when(condition, 1).otherwise(0)).alias(name)


def imaging_state(inventory: DataFrame, wanted: Sequence[str], known: Sequence[str]) -> DataFrame:
    """subject, has_<name> for each wanted series (by its whole name), has_unknown for any not among the known ones, has_all."""
    flags = inventory.groupBy("subject").agg(*[any_row(F.col("study") == w, f"has_{w}") for w in wanted], any_row(~F.col("study").isin(*known), "has_unknown"))
    return flags.withColumn("has_all", F.least(*[F.col(f"has_{w}") for w in wanted], F.lit(1)))


def map_count_rule(inventory: DataFrame, maps: int, files: int) -> DataFrame:
    """subject, modality, maps, exact: groups with a series of at least `files` files that aren't just `maps` series with exactly that many."""
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    g = inventory.groupBy("subject", "modality").agg(F.count("*").alias("maps"), one(F.col("n_files") == files).alias("exact"), one(F.col("n_files") >= files).alias("__large"))
    return g.filter((F.col("__large") > 0) & ~((F.col("maps") == maps) & (F.col("exact") == maps))).drop("__large")


def empty_groups(groups: DataFrame, members: DataFrame, key: str = "subject") -> DataFrame:
    """The declared groups' keys that no member has."""
    return groups.select(key).join(members, key, "left_anti")


def scan_selection(inventory: DataFrame, needed: Sequence[str], extra: str, files: int, missing_extra: str) -> DataFrame:
    """Every subject with its first modality that holds all needed series of at least `files` files: subject, modality, several (more such modalities), result (`selected`, `missing_extra` without the extra series, `no series`)."""
    held = [any_row(F.col("study") == n, f"__{i}") for i, n in enumerate(needed)]
    g = inventory.filter(F.col("n_files") >= files).groupBy("subject", "modality").agg(*held, any_row(F.col("study") == extra, "__extra"))
    g = g.filter(F.least(*[F.col(f"__{i}") for i in range(len(needed))], F.lit(1)) == 1)
    best = g.groupBy("subject").agg(F.min_by("__extra", "modality").alias("__extra"), F.min("modality").alias("modality"), (F.count("*") > 1).alias("several"))
    result = F.when(F.col("__extra").isNull(), "no series").when(F.col("__extra") == 1, "selected").otherwise(missing_extra)
    return inventory.select("subject").distinct().join(best, "subject", "left").select("subject", "modality", F.coalesce("several", F.lit(False)).alias("several"), result.alias("result"))


def label_presence(inventory: DataFrame, label: str, files: int) -> DataFrame:
    """subject, has_label: whether one of the subject's series of at least `files` files is the label's."""
    return inventory.filter(F.col("n_files") >= files).groupBy("subject").agg(F.bool_or(F.col("study") == label).alias("has_label"))


def device_inventory(scans: DataFrame, keys: Sequence[str], model: str, scan: str) -> DataFrame:
    """keys (modality, maker), n scans, distinct models, and the smallest scan id as first_<scan>."""
    return scans.groupBy(*keys).agg(F.count("*").alias("n"), F.countDistinct(model).alias("models"), F.min(scan).alias(f"first_{scan}"))


def merge_cohort(rows: DataFrame, cohort: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Every row with the subject and columns of the cohort whose subject is its key, null where there is none."""
    return rows.join(cohort.select("subject", *columns), F.col(key) == F.col("subject"), "left")


def volume_reference_join(volumes: DataFrame, reference: DataFrame, key: str = "anonymised_id") -> DataFrame:
    """Volumes with the external reference's columns, for subjects in both; `key` is the reference's name for the subject."""
    return volumes.join(reference.withColumnRenamed(key, "subject"), "subject")


def linear_fit(df: DataFrame, y: str, x: str) -> DataFrame:
    """One row: slope, intercept and r2 of y on x; null for fewer than two points or one x."""
    return df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))


def cohort_profile(clinical: DataFrame, by: str, value: str, flag: Column, flagged: str) -> DataFrame:
    """by, n, median, std, youngest and oldest of the value, and the number of subjects where the flag holds. One row per subject comes in."""
    return clinical.groupBy(by).agg(
        F.count("*").alias("n"), F.percentile(value, F.lit(0.5)).alias("median"), F.stddev_pop(value).alias("std"),
        F.min(value).alias("youngest"), F.max(value).alias("oldest"), F.count(F.when(flag, 1)).alias(flagged),
    )


def row_difference(rows: DataFrame, taken: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows whose key is not among the taken ones."""
    return rows.join(taken.select(*keys), list(keys), "left_anti")


def first_subjects(df: DataFrame, n: int) -> DataFrame:
    """All rows of the n smallest subjects."""
    return df.join(df.select("subject").distinct().orderBy("subject").limit(n), "subject", "left_semi")


def split_by_subjects(df: DataFrame, chosen: DataFrame) -> DataFrame:
    """df with `part`: test for the chosen subjects, train for all others."""
    s = chosen.select("subject")
    return df.join(s, "subject", "left_semi").withColumn("part", F.lit("test")).unionByName(df.join(s, "subject", "left_anti").withColumn("part", F.lit("train")))
