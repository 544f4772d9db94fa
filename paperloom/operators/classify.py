"""Page types by weighted signals, as unrolled Column expressions that stay in generated code."""

from __future__ import annotations

import fnmatch

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import url as U

PAGE_TYPES = "tutorial api_reference function_reference guide concepts examples getting_started faq release_notes troubleshooting migration configuration".split()
#: Folders of a path and words of a title by type, tried as substrings; those that hold another of a type are left out.
_FOLDERS = dict(
    tutorial="/tutorial;/learn", api_reference="/api;/api-reference;/reference", function_reference="/function;/method", guide="/guide;/howto;/how-to",
    concepts="/concept;/architecture;/overview;/background", examples="/example;/sample", faq="/faq", release_notes="/release-notes;/releasenotes;/changelog;/releases;/whatsnew;/what-is-new",
    getting_started="/getting-started;/gettingstarted;/quickstart;/start;/installation", troubleshooting="/troubleshooting;/troubleshoot;/error;/common-issues;/common-problems",
    migration="/migration;/migrating;/migrate;/upgrade;/upgrading;/porting", configuration="/configuration;/config;/configure;/settings;/setup",
)
_TITLES = dict(
    configuration="config;environment;parameters;settings;setup", migration="migrating;migration;porting;upgrade;upgrading",
    troubleshooting="common errors;common issues;debugging;troubleshoot", release_notes="changelog;release;version;what's new;whats new",
    faq="common questions;faq;frequently asked", getting_started="beginner;first steps;getting started;installation;quick start;quickstart",
    examples="demo;example;sample", concepts="architecture;background;concept;overview", guide="best practices;guide;how to;howto",
    function_reference="function;method;signature", api_reference="api", tutorial="step-by-step;tutorial",
)
_HEADINGS = dict(
    tutorial=r"^(step\s|exercise)", api_reference=r"^(parameters|(returns?|raises?|exceptions?|arguments?|syntax)\b|\w+\(.*\)\s*$)",
    function_reference=r"^(parameters|(returns?|signature|arguments?)\b)", configuration="^(configuration|environment|options|parameters|properties|settings)",
    examples=r"^((examples?|sample|usage)\b|demonstration)",
)
_METAS = [("tutorial", "article:section:tutorial;og:type:article"), ("api_reference", "og:type:website;page:class:apidocs"), ("getting_started", "article:section:getting-started"), ("faq", "page:class:faq")]
HINTS = dict(
    tutorial_paths="tutorial", reference_paths="api_reference", guide_paths="guide", concept_paths="concepts", example_paths="examples", faq_paths="faq", getting_started_paths="getting_started",
    api_paths="api_reference", function_ref_paths="function_reference", release_notes_paths="release_notes", troubleshooting_paths="troubleshooting", migration_paths="migration", configuration_paths="configuration",
)


def _any(text: Column, needles: str) -> Column:
    out = F.lit(False)
    for x in needles.split(";"):
        out = out | text.contains(x)
    return out


def _some(texts: Column, pattern: str) -> Column:
    return F.exists(texts, lambda x: x.rlike("(?i)" + pattern))


def inputs(url: Column, title: Column, markdown: Column, code_chars: Column, breadcrumb: Column, meta: Column) -> dict[str, Column]:
    """What the signals read, as columns of their own: each is used many times and computed once."""
    pairs = F.transform(F.map_entries(meta), lambda e: F.concat(e["key"], F.lit(":"), e["value"]))
    return {
        "__path": F.lower(U.path(url)), "__title": F.lower(title), "__ratio": code_chars / F.greatest(F.length(markdown), F.lit(1)),
        "__crumbs": F.coalesce(F.lower(F.array_join(breadcrumb, " ")), F.lit("")), "__meta": F.coalesce(F.lower(F.array_join(pairs, " ")), F.lit("")),
    }


def signals(headings: Column) -> list[tuple[float, dict[str, Column]]]:
    """(weight, page type -> value in [0, 1], null where there is none) of each of the six signals, over inputs()."""
    hit = lambda c: F.when(c, 1.0)
    ratio, pairs = F.col("__ratio"), F.col("__meta")
    high, some = ratio > 0.4, (ratio <= 0.4) & (ratio > 0.1)
    code = dict(
        examples=F.when(high, F.least(ratio, F.lit(1.0))), api_reference=F.when(high, ratio * 0.7), tutorial=F.when(some, ratio * 1.5),
        guide=F.when(some, ratio).when(ratio <= 0.1, 1 - ratio), concepts=F.when(ratio <= 0.1, 1 - ratio),
    )
    metas, before = {}, F.lit(False)
    for kind, needles in _METAS:
        metas[kind] = hit(_any(pairs, needles) & ~before)
        before = before | _any(pairs, needles)
    return [
        (0.30, {t: hit(_any(F.col("__path"), _FOLDERS[t])) for t in PAGE_TYPES}),
        (0.25, {t: hit(_any(F.col("__title"), _TITLES[t])) for t in PAGE_TYPES}),
        (0.20, {t: hit(_some(headings, p)) for t, p in _HEADINGS.items()}),
        (0.10, code),
        (0.10, {t: hit(_any(F.col("__crumbs"), _TITLES[t])) for t in PAGE_TYPES}),
        (0.05, metas),
    ]


def best(signal: list[tuple[float, dict[str, Column]]]) -> Column:
    """struct(__sum, __order, __type): the largest weighted sum; of equal ones the type whose first signal came first."""
    options = []
    for k, kind in enumerate(PAGE_TYPES):
        own = [(n, w, v[kind]) for n, (w, v) in enumerate(signal) if kind in v]
        total, first = F.lit(0.0), F.lit(99)
        for n, weight, value in own:
            total = total + F.coalesce(value, F.lit(0.0)) * weight
        for n, _, value in reversed(own):
            first = F.when(value.isNotNull(), n).otherwise(first)
        options.append(F.struct(total.alias("__sum"), (-(first * 100 + k)).alias("__order"), F.lit(kind).alias("__type")))
    return F.array_max(F.array(*options))


def hinted(url: Column, hints: dict[str, list[str]]) -> Column:
    """The type of the first hint, in fixed order, with a glob that fits the whole URL; null without one."""
    out = F.lit(None).cast("string")
    for name, kind in reversed(HINTS.items()):
        globs = [fnmatch.translate(p.replace("{version}", "*")).replace(r"\z", r"\Z") for p in hints.get(name, [])]
        if globs:
            out = F.when(url.rlike("^(?:" + "|".join(f"(?:{g})" for g in globs) + ")"), kind).otherwise(out)
    return out


def classify(pages: DataFrame, hints: dict[str, list[str]] | None = None, threshold: float = 0.70) -> DataFrame:
    """pages (url, title, headings, markdown, code_blocks, breadcrumb, raw_metadata) with page_type and confidence.

    A hint's type has confidence 1; else the best scored one if it reaches the threshold; else unknown with 0.
    """
    code = F.aggregate(F.transform("code_blocks", lambda b: F.length(b["content"])), F.lit(0), lambda a, x: a + x)
    rows = pages.withColumns(inputs(F.col("url"), F.col("title"), F.col("markdown"), code, F.col("breadcrumb"), F.col("raw_metadata")))
    # a generator of one row keeps the optimizer from repeating the whole score wherever it is read
    rows = rows.select("*", F.inline(F.array(best(signals(F.col("headings"))))))
    sure, hint = F.col("__sum") >= threshold, hinted(F.col("url"), hints or {})
    kind = F.coalesce(hint, F.when(sure, F.col("__type")), F.lit("unknown"))
    confidence = F.when(hint.isNotNull(), 1.0).when(sure, F.least(F.col("__sum"), F.lit(1.0))).otherwise(0.0)
    return rows.select(*pages.columns, kind.alias("page_type"), confidence.alias("confidence"))
