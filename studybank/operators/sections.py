"""Report sectioning, overrides, section pick and concatenation.

Rule: a header is ``\\n <UPPER NAME>:<blank>``; the preamble runs up to the
header *name*; a section body runs from after its header to the next header
that starts at or after the first newline of the body (a header on the body's
first line is skipped).  A report without headers is one ``full report``
section.  This is expressed with one native ``regexp_extract_all`` whose body
group stops at the first newline that begins a header; the possessive ``*+``
keeps Java's regex engine iterative on 400 kB reports.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from studybank import constants as K
from studybank.functions.text import WS, normalise_section, py_strip
from studybank.session import spread

_NAME = r"[A-Z ()/,-]+"
# one match = header + body; the body stops at the first newline that starts a header
SECTION_PATTERN = r"\n " + _NAME + r":\s[^\n]*+(?:\n(?! " + _NAME + r":\s)[^\n]*+)*+"
HEADER_PATTERN = r"^\n (" + _NAME + r"):\s"
PREAMBLE_PATTERN = r"(?s)^(.*?\n )" + _NAME + r":\s"

SECTION_TYPE = "array<struct<pos:int,name:string,text:string,start:int>>"


def _blank(c: Column) -> Column:
    """Python ``s.strip() == ''`` without copying the text: no character
    outside the whitespace class."""
    return ~c.rlike("[^" + WS[1:-1] + "]")


def _with_sections(df: DataFrame, col: str, out: str = "sections",
                   normalise: bool = True) -> DataFrame:
    """Add ``out`` = array of ``struct(pos, name, text, start)`` per report.

    One ``regexp_extract_all`` scans the report; a single ``aggregate`` then
    walks the matches once, carrying the running start offset.  Each input is
    referenced once, so the plan stays linear even when the optimiser inlines
    this projection into a later generator."""
    name_fn = normalise_section if normalise else (lambda n: F.lower(n))
    text = F.col(col)
    ms = F.regexp_extract_all(text, F.lit(SECTION_PATTERN), 0)
    pre = F.regexp_extract(text, PREAMBLE_PATTERN, 1)
    init = F.struct(
        F.array(F.struct(F.lit(0).alias("pos"), F.lit("preamble").alias("name"),
                         pre.alias("text"), F.lit(0).alias("start"))).alias("arr"),
        (F.length(pre) - 2).alias("p"),
        text.alias("full"))

    def step(acc, m):
        h = F.length(F.regexp_extract(m, HEADER_PATTERN, 0))
        sec = F.struct(F.size(acc["arr"]).alias("pos"),
                       name_fn(F.regexp_extract(m, HEADER_PATTERN, 1)).alias("name"),
                       F.substring(m, h + 1, F.lit(1 << 30)).alias("text"),
                       (acc["p"] + h).cast("int").alias("start"))
        return F.struct(F.concat(acc["arr"], F.array(sec)).alias("arr"),
                        (acc["p"] + F.length(m)).alias("p"), acc["full"].alias("full"))

    def finish(acc):
        full = F.array(F.struct(F.lit(0).alias("pos"), F.lit("full report").alias("name"),
                                acc["full"].alias("text"), F.lit(0).alias("start")))
        return F.when(F.size(acc["arr"]) == 1, full).otherwise(acc["arr"])

    return df.withColumn(out, F.aggregate(ms, init, step, finish))


def drop_empty_body(sections: Column) -> Column:
    """Remove empty (whitespace-only) impression / findings sections."""
    body = F.array(*[F.lit(x) for x in K.BODY_SECTIONS])
    return F.filter(sections, lambda s: ~(F.array_contains(body, s["name"]) & _blank(s["text"])))


def add_last_paragraph(sections: Column) -> Column:
    """Without impression or findings, split the last section at its first
    blank-line break: the head stays, the rest becomes ``last_paragraph``.
    One pass over the array (the input is referenced once)."""
    brk = K.PARAGRAPH_BREAK
    body = F.array(*[F.lit(x) for x in K.BODY_SECTIONS])
    sec_type = "struct<pos:int,name:string,text:string,start:int>"
    init = F.struct(F.array().cast(f"array<{sec_type}>").alias("arr"),
                    F.lit(None).cast(sec_type).alias("last"), F.lit(False).alias("body"))

    def step(acc, s):
        kept = F.when(acc["last"].isNull(), acc["arr"]).otherwise(
            F.concat(acc["arr"], F.array(acc["last"])))
        return F.struct(kept.alias("arr"), s.alias("last"),
                        (acc["body"] | F.array_contains(body, s["name"])).alias("body"))

    def finish(acc):
        last = acc["last"]
        at = F.instr(last["text"], brk)
        head = F.substring(last["text"], 1, at - 1)
        tail = F.substring(last["text"], at + F.lit(len(brk)), F.lit(1 << 30))
        new_last = F.struct(last["pos"].alias("pos"), last["name"].alias("name"),
                            head.alias("text"), last["start"].alias("start"))
        para = F.struct((last["pos"] + 1).alias("pos"), F.lit("last_paragraph").alias("name"),
                        tail.alias("text"), (last["start"] + F.length(head)).cast("int").alias("start"))
        split = F.concat(acc["arr"], F.array(new_last, para))
        plain = F.when(last.isNull(), acc["arr"]).otherwise(F.concat(acc["arr"], F.array(last)))
        return F.when(~acc["body"] & last.isNotNull() & (at > 0), split).otherwise(plain)

    return F.aggregate(sections, init, step, finish)


def section_arrays(df: DataFrame, col: str = "text", key: str = "study_id") -> DataFrame:
    """``(key, sections)`` with empty body sections dropped and the last
    paragraph split off (each step reads the materialised array column)."""
    raw = _with_sections(spread(df.select(key, col)), col, "_raw")
    kept = raw.select(key, drop_empty_body(F.col("_raw")).alias("_kept"))
    return kept.select(key, add_last_paragraph(F.col("_kept")).alias("sections"))


def split_sections(df: DataFrame, col: str = "text", key: str = "study_id",
                   keep_array: bool = False) -> DataFrame:
    """Long sections ``(key, pos, name, text, start)``; ``pos`` renumbered
    0..n-1 after empty sections are dropped."""
    arr = section_arrays(df, col, key)
    if keep_array:
        return arr
    return arr.select(key, F.posexplode("sections").alias("pos", "s")).select(
        key, F.col("pos").cast("int").alias("pos"), F.col("s.name").alias("name"),
        F.col("s.text").alias("text"), F.col("s.start").alias("start"))


def pick_section(sections: DataFrame, key: str = "study_id",
                 priority=tuple(K.SECTION_PRIORITY), out: str = "report") -> DataFrame:
    """Per study: the stripped text of the *last* section of the first name in
    ``priority`` that occurs, or ``""`` when none occurs.  ``min_by`` aggregates
    partially, so a study with many sections never forms one big group."""
    pri = F.array(*[F.lit(p) for p in priority])
    p = F.coalesce(F.array_position(pri, F.col("name")).cast("int"), F.lit(0))
    rank = F.struct(F.when(p > 0, p).otherwise(F.lit(1 << 20)).alias("p"),
                    (-F.col("pos")).alias("q"))
    agg = sections.groupBy(key).agg(F.min_by(F.struct(p.alias("p"), F.col("text").alias("t")),
                                             rank).alias("_m"))
    return agg.select(key, F.when(F.col("_m.p") > 0, py_strip(F.col("_m.t")))
                      .otherwise(F.lit("")).alias(out))


def concat_sections(sections: DataFrame, key: str = "study_id",
                    names=("impression", "findings", "last_paragraph"), sep: str = "",
                    out: str = "report") -> DataFrame:
    """Stripped last section of each listed name, concatenated in list order
    with ``sep``; absent or empty ones are skipped, studies with none give ``""``."""
    order = F.array(*[F.lit(n) for n in names])
    o = F.coalesce(F.array_position(order, F.col("name")).cast("int"), F.lit(0))
    last = sections.groupBy(key, o.alias("o")).agg(
        F.max_by("text", "pos").alias("t"))
    parts = last.groupBy(key).agg(F.collect_list(
        F.when(F.col("o") > 0, F.struct(F.col("o"), py_strip(F.col("t")).alias("t")))).alias("p"))
    return parts.select(key, F.array_join(F.filter(F.transform(F.array_sort("p"),
                                                               lambda x: x["t"]),
                                                   lambda t: t != ""), sep).alias(out))


def overrides_table(spark) -> DataFrame:
    """The fixed per-study overrides as one small table, of literals: the planner takes the size of rows from Python as
    unknown and would send the reports to every task instead."""
    rows = [(s, n, None, None) for s, n in K.OVERRIDE_SECTION_NAMES.items()]
    rows += [(s, None, a, b) for s, (a, b) in K.OVERRIDE_SLICES.items()]
    kinds = {"study_id": "string", "section_name": "string", "start": "int", "end": "int"}
    return spark.range(1).select(F.inline(F.array(*[
        F.struct(*[F.lit(v).cast(kind).alias(c) for v, (c, kind) in zip(row, kinds.items())]) for row in rows])))


def apply_overrides(reports: DataFrame, sections: DataFrame, overrides: DataFrame,
                    key: str = "study_id", text: str = "text",
                    out: str = "report") -> DataFrame:
    """Body text per study: a slice ``text[start:end]`` or the last section of
    a given name where an override exists, else the priority pick.

    ``status`` is ``missing_section`` when the named override section is absent
    (text null) instead of failing the job.  ``overrides`` is a user table of
    bounded size; it is joined normally so AQE can broadcast it at run time."""
    ov = overrides.select(key, "section_name", "start", "end")
    sliced = (reports.join(ov.where(F.col("start").isNotNull()), key)
              .select(key, F.substring(F.col(text), F.col("start") + 1,
                                       F.greatest(F.col("end") - F.col("start"), F.lit(0)))
                      .alias(out)))
    named = (sections.join(ov.where(F.col("section_name").isNotNull()), key)
             .where(F.col("name") == F.col("section_name"))
             .groupBy(key).agg(py_strip(F.max_by("text", "pos")).alias(out)))
    named_all = (ov.where(F.col("section_name").isNotNull()).select(key)
                 .join(reports.select(key), key, "left_semi")
                 .join(named, key, "left"))
    plain = pick_section(sections.join(ov.select(key), key, "left_anti"), key, out=out)
    return (sliced.unionByName(named_all).unionByName(plain)
            .withColumn("status", F.when(F.col(out).isNull(), F.lit("missing_section"))
                        .otherwise(F.lit("ok"))))


def only_impression(sections: DataFrame, key: str = "study_id") -> DataFrame:
    """The impression passage per study with a ``status``: ``ok``,
    ``no_impression``, ``several_impressions`` or ``empty_impression``."""
    agg = sections.groupBy(key).agg(
        F.count(F.when(F.col("name") == "impression", 1)).alias("_n"),
        F.max_by(F.when(F.col("name") == "impression", F.col("text")),
                 F.when(F.col("name") == "impression", F.col("pos"))).alias("impression"))
    return agg.select(
        key, "impression",
        F.when(F.col("_n") == 0, "no_impression").when(F.col("_n") > 1, "several_impressions")
        .when(_blank(F.col("impression")), "empty_impression").otherwise("ok").alias("status"))
