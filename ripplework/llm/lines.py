"""Line dedup by a log-template tree. Native: DataFrame functions only.

A line is parsed at fixed depth: number of tokens, then its leading tokens; tokens with digits are variable fields from
the start. A leaf of that tree holds a list of groups, each with a leader: the form with the most documents in reach,
then, in rounds, that of the forms no leader has taken, until none has `min_docs` documents in reach. A form joins the
leader it agrees with most, in `similar` of all places at least; the places that differ are further variable fields. Other
forms are templates of their own. A template that recurs in `min_docs` documents or more is dropped from all documents
but the first that has it (least id, then least hash of the text); there its first line stays. A line of `long_tokens`
tokens or more, and in no such template, is dropped likewise if its very form (digits masked) recurs in `exact_docs`
documents.

What is in reach is bounded without pairs: two forms that agree that far have one of `n_differ + 1` runs of places in
common, so a form reaches no more documents than the groups that share a run with it hold. A round of jobs finds all the
next leaders of a leaf whose order cannot matter (see `leaders`); forms that share no run with others need none.

Lines are counted by 64-bit hashes; a form's text is only read in leaves that enough documents reach. Hot lines shrink
to one row a task before any shuffle by template; joins on a hot form are split by adaptive execution.

Defined results: null text has no lines and stays null; a line without a fixed token (blank, or numbers only) is no
template and stays; a document is an id and a text, so rows equal in both count as one and keep or lose the same lines,
and rows with a null id (which comes first) or with equal ids but other texts count each; a document whose lines all go
keeps its row with empty text; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ripplework.llm.common import SPACE
from ripplework.session import materialize, table

DEPTH = 2
SIMILAR = 0.7
MIN_DOCS = 8
MIN_TOKENS = 1
#: From so many tokens on a form counts as a passage, dropped when it recurs as it stands in so many documents.
LONG_TOKENS = 10
EXACT_DOCS = 2
#: Forms of a leaf that a first round tries as leaders.
TRIED = 32
#: A word with a digit, from its start on; a word is read once.
FIELD = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9]*+[0-9][^\x20\x09-\x0D]*+"


def _forms(docs: DataFrame, id_col: str, text_col: str, depth: int, min_tokens: int, long_tokens: int = LONG_TOKENS) -> DataFrame:
    """(doc, pos, leaf, form, long, masked) of every line with a fixed token; a document is its id and its text's hash."""
    text = F.col(text_col)
    doc = F.struct(F.col(id_col).alias("id"), F.xxhash64(text).alias("key"))
    rows = docs.select(doc.alias("doc"), text.alias("text")).select("doc", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    line = F.col("line")
    odd = line.rlike(r"[0-9\t\x0b-\r]") | line.contains("  ") | line.startswith(" ") | line.endswith(" ")
    clean = F.when(odd, F.trim(F.regexp_replace(F.regexp_replace(line, FIELD, "<*>"), SPACE, " "))).otherwise(line)  # words one space apart
    rows = rows.select("doc", "pos", clean.alias("masked"))
    blank = lambda c, x: F.replace(c, F.lit(x), F.lit(""))
    rows = rows.withColumn("tokens", F.length("masked") - F.length(blank(F.col("masked"), " ")) + 1)
    fixed = F.when(F.col("masked").contains("<*>"), blank(blank(F.col("masked"), "<*>"), " ") != "").otherwise(F.col("masked") != "")
    # A filter on a deterministic column would move below the projections and take copies of `clean` along.
    rows = rows.withColumn("__ok", (F.col("tokens") >= min_tokens) & fixed & (F.monotonically_increasing_id() >= 0)).where("__ok")
    leaf = F.xxhash64("tokens", F.substring_index("masked", " ", depth))
    return rows.select("doc", "pos", leaf.alias("leaf"), F.xxhash64("masked").alias("form"), (F.col("tokens") >= long_tokens).alias("long"), "masked")


def _agree(a: Column, b: Column) -> Column:
    """In how many places two lines of one leaf are the same."""
    return F.size(F.filter(F.zip_with(F.split(a, " "), F.split(b, " "), lambda x, y: x == y), lambda x: x))


def _runs(masked: Column, depth: int, similar: float) -> Column:
    """Hashes of the runs of places behind the leading ones: one more than places may differ, so alike forms share one."""

    def of(tokens: Column) -> Column:
        k = F.floor(F.size(tokens) * F.lit(1 - similar) + F.lit(1e-6)).cast("int") + 1
        m = F.greatest(F.size(tokens) - depth, F.lit(0))
        cut = lambda j: F.floor(j * m / k).cast("int")
        return F.transform(F.sequence(F.lit(0), k - 1), lambda j: F.xxhash64(j, F.array_join(F.slice(tokens, cut(j) + depth + 1, cut(j + 1) - cut(j)), " ")))

    return F.flatten(F.transform(F.array(F.split(masked, " ")), of))  # so that a line is split once, not for each run


def leaders(forms: DataFrame, depth: int = DEPTH, similar: float = SIMILAR, min_docs: int = MIN_DOCS, tried: int = TRIED) -> DataFrame | None:
    """(leaf, leader, pattern, held, led) from (leaf, form, docs, masked), the earlier leader the one with the greater
    (held, led, leader); None if no leaf has a group of several forms.

    A form's rank (documents its best run holds, its own, its hash) only falls while forms go, so leaders in the order of the
    rounds are leaders by falling rank. A round therefore tries the `tried` highest of each leaf at once. Who has too few
    documents alike now never will have more; who has enough leads, unless what one of higher rank may take shares a run
    with it or the other way round: these wait, since their rank may change. `tried` doubles with each round.
    """
    several = forms.groupBy("leaf").agg(F.count("*").alias("n")).where("n > 1").select("leaf")
    pool = forms.join(several, "leaf", "left_semi").withColumn("runs", _runs(F.col("masked"), depth, similar)).withColumn("lead", F.lit(True))
    pool, found = materialize(pool, "runs"), []
    while True:
        runs = pool.select("leaf", "form", "docs", F.explode("runs").alias("run"))
        shared = runs.groupBy("leaf", "run").agg(F.sum("docs").alias("held"), F.count("*").alias("n")).where("n > 1").drop("n")
        reach = runs.join(shared, ["leaf", "run"]).groupBy("leaf", "form").agg(F.sum(F.col("held") - F.col("docs")).alias("others"), F.max("held").alias("held"))
        near = materialize(pool.join(reach, ["leaf", "form"]), "reach")  # forms without a run in common are out
        able = near.where(F.col("lead") & (F.col("docs") + F.col("others") >= min_docs))
        place = F.row_number().over(W.partitionBy("leaf").orderBy(F.desc("held"), F.desc("docs"), F.desc("form")))
        lead = able.withColumn("place", place).where(F.col("place") <= tried)
        lead = lead.select("leaf", "place", F.col("form").alias("leader"), F.col("masked").alias("pattern"), "held", F.col("docs").alias("led"), F.col("runs").alias("its_runs"))
        lead = materialize(lead, "lead")  # written, so that the join by leaf stands on plain shuffles, which are split
        meets = F.arrays_overlap("runs", "its_runs")  # alike forms do
        like = _agree(F.col("masked"), F.col("pattern")) >= similar * F.size(F.split("pattern", " "))
        met = near.select("leaf", "form", "docs", "masked", "runs").join(lead.select("leaf", "place", "pattern", "its_runs"), "leaf").where(meets)
        met = materialize(met.select("leaf", "place", "form", "docs", like.alias("like")), "met")
        if not met.take(1):
            break
        good = met.where("like").groupBy("leaf", "place").agg(F.sum("docs").alias("n")).where(F.col("n") >= min_docs).drop("n")
        good = materialize(met.join(good, ["leaf", "place"], "left_semi"), "good")
        first = good.groupBy("leaf", "form").agg(F.min("place").alias("meets"), F.min(F.when(F.col("like"), F.col("place"))).alias("takes"))
        waits = (F.col("takes") < F.col("place")) | (F.col("like") & (F.col("meets") < F.col("place")))
        leads = good.join(first, ["leaf", "form"]).groupBy("leaf", "place").agg(F.max(F.coalesce(waits, F.lit(False))).alias("waits"))
        leads = materialize(leads, "leads")
        found.append(lead.join(leads.where("not waits"), ["leaf", "place"]).select("leaf", "leader", "pattern", "held", "led"))
        taken = good.where("like").join(leads.where("not waits"), ["leaf", "place"]).select("leaf", "form").distinct()
        out = lead.join(leads.where("waits"), ["leaf", "place"], "left_anti").select("leaf", F.col("leader").alias("form"), F.lit(True).alias("out"))
        rest = near.join(lead.select("leaf").distinct(), "leaf", "left_semi").join(taken, ["leaf", "form"], "left_anti").join(out, ["leaf", "form"], "left")
        pool, tried = rest.select("leaf", "form", "docs", "masked", "runs", (F.col("lead") & F.col("out").isNull()).alias("lead")), min(2 * tried, 1 << 20)
    return reduce(DataFrame.union, found) if found else None


def recurring(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, similar: float = SIMILAR, min_docs: int = MIN_DOCS, min_tokens: int = MIN_TOKENS, long_tokens: int = LONG_TOKENS, exact_docs: int = EXACT_DOCS) -> tuple[DataFrame, DataFrame]:
    """(templates, drops): (leaf, template, pattern, docs) that recur, and (doc (id, key), dropped positions)."""
    lines = materialize(_forms(docs, id_col, text_col, depth, min_tokens, long_tokens), "lines")
    per_form = lines.groupBy("leaf", "form", "long", "doc").agg(F.lit(1).alias("one")).groupBy("leaf", "form", "long").agg(F.count("*").alias("docs"))
    busy = lines.groupBy("leaf", "doc").agg(F.lit(1).alias("one")).groupBy("leaf").agg(F.count("*").alias("docs")).where(F.col("docs") >= min_docs).select("leaf", F.lit(True).alias("busy"))
    busy = materialize(busy, "busy")
    per_form = per_form.join(busy, "leaf", "left").withColumn("exact", F.col("long") & (F.col("docs") >= exact_docs))
    per_form = materialize(per_form.where("exact or busy").drop("long"), "counts")
    texts = lines.select("leaf", "form", "masked")
    text_of = lambda some: texts.join(some, "leaf", "left_semi").groupBy("leaf", "form").agg(F.min("masked").alias("masked"))
    tree = per_form.where("busy")
    forms = materialize(tree.select("leaf", "form", "docs").join(text_of(busy), ["leaf", "form"]), "forms")
    lead = leaders(forms, depth, similar, min_docs)
    general = forms.select("leaf", "form", "masked", F.col("form").alias("template"), F.col("masked").alias("pattern"))
    if lead is not None:
        same = _agree(F.col("masked"), F.col("pattern"))
        joined = forms.join(lead, "leaf").where(same >= similar * F.size(F.split("pattern", " ")))
        best = joined.groupBy("leaf", "form").agg(F.max(F.struct(same.alias("same"), "held", "led", "leader", "pattern")).alias("m"))
        general = forms.join(best, ["leaf", "form"], "left").select("leaf", "form", "masked", F.coalesce("m.leader", "form").alias("template"), F.coalesce("m.pattern", "masked").alias("pattern"))
    general = materialize(general, "templates")
    groups = per_form.join(general.select("leaf", "form", "template"), ["leaf", "form"], "left").select("leaf", "form", "exact", F.coalesce("template", "form").alias("template"))
    hits = materialize(lines.drop("long", "masked").join(materialize(groups, "groups"), ["leaf", "form"]), "hits")

    def first(name: str, least: int, rows: DataFrame) -> DataFrame:
        by_doc = rows.groupBy("leaf", name, "doc").agg(F.min("pos").alias("pos"))
        return by_doc.groupBy("leaf", name).agg(F.count("*").alias("n_docs"), F.min(F.struct("doc", "pos")).alias("first")).where(F.col("n_docs") >= least)

    known = materialize(first("template", min_docs, hits), "recurring")
    single = materialize(first("form", exact_docs, hits.where("exact").join(known, ["leaf", "template"], "left_anti")), "repeats")
    field = F.array_join(F.zip_with(F.split("pattern", " "), F.split("masked", " "), lambda x, y: F.when(x == y, x).otherwise(F.lit("<*>"))), " ")
    templates = general.join(known, ["leaf", "template"]).groupBy("leaf", "template").agg(F.min(field).alias("pattern"), F.max("n_docs").alias("docs"))
    named = texts.join(single, ["leaf", "form"], "left_semi").groupBy("leaf", "form").agg(F.min("masked").alias("pattern"))
    templates = templates.union(single.join(named, ["leaf", "form"]).select("leaf", "form", "pattern", F.col("n_docs").alias("docs")))
    bad = hits.join(known.select("leaf", "template", "first"), ["leaf", "template"]).select("doc", "pos", "first")
    bad = bad.union(hits.join(single.select("leaf", "form", "first"), ["leaf", "form"]).select("doc", "pos", "first"))
    gone = bad.where(~F.struct("doc", "pos").eqNullSafe(F.col("first")))
    drops = gone.groupBy("doc").agg(F.collect_set("pos").alias("dropped"))  # at most the lines of one document
    return templates, drops


def drop_recurring(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None, **options) -> DataFrame:
    """The documents without lines of recurring templates, all columns kept; `length_col`, if given, is set anew."""
    _, drops = recurring(docs, id_col, text_col, **options)
    drops = drops.select(F.col("doc.id").alias("__doc"), F.col("doc.key").alias("__key"), F.col("dropped").alias("__dropped"))
    rows = docs.withColumn("__line_key", F.xxhash64(text_col))
    rows = rows.join(drops, F.col(id_col).eqNullSafe(F.col("__doc")) & (F.col("__line_key") == F.col("__key")), "left")
    left = F.array_join(F.filter(F.split(text_col, "\n"), lambda x, i: ~F.array_contains("__dropped", i)), "\n")
    text = F.when(F.col("__dropped").isNull(), F.col(text_col)).otherwise(left)
    n = F.coalesce(F.size("__dropped"), F.lit(0))
    rows = rows.withColumn("__n_dropped", F.when(n < 0, 0).otherwise(n)).withColumn(text_col, text)
    if length_col:
        rows = rows.withColumn(length_col, F.length(text_col).cast("long"))
    return rows.select(*docs.columns, "__n_dropped")


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = drop_recurring(docs)
    return out.select("doc_id", F.size(F.split("text", "\n")).cast("long").alias("lines_left"), F.col("__n_dropped").cast("long").alias("lines_dropped"), F.sha2("text", 256).alias("text_sha256"))
