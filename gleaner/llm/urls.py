"""URL filter: longest matching rule, else a learned path-template tree.

Native DataFrame code throughout. Per host, the path's segments form a tree, as deep as the paths are.
Segments that look like values (numbers, ids, dates) become wildcards; on every level, a branch whose
labelled share differs from that of its siblings stands alone, and all others, unlabelled ones too, merge
into one wildcard branch. A node with few labelled pages is a leaf. A template is rejected if its labelled
share, smoothed towards a prior, reaches ``reject_at``.

Labels: a rule's verdict; else a seed word in the host (bad); else the page's content (bad if it holds
little text or mostly link text, good otherwise). So labels differ between pages of one host, and a page
without content, or a good page among bad ones, is judged by its template.

Edge cases: a null URL, or one without ``://``, has an empty host and path; pages without HTML, or a table
without that column, have no label of their own; a null page_id is a row like others. Repeated rows are
judged alike and all kept. Very long URLs are read whole. Empty tables give empty results.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import ascii_lower, cut

#: (verdict, host, path): fits the host and its subdomains where the URL's path starts with the path.
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)

#: Words that mark a host as unwanted; they label its pages where no rule does.
SEED_WORDS = ("casino", "bets", "pills", "adult", "spam", "ads-track")


@dataclass(frozen=True)
class TreeParams:
    prior: float = 0.1  # share of bad pages expected without labels
    strength: float = 2.0  # labelled pages that the prior weighs as much as
    z: float = 2.58  # normal quantile of the similarity test
    min_labelled: int = 5  # branches with fewer labelled pages never stand alone, nodes with fewer have no branches
    reject_at: float = 0.5
    thin: int = 500  # a page with fewer characters of text (white space not counted) is bad
    links: float = 0.25  # so is one with this share of them in links
    salts: int = 16  # parts of a template's pages in the join


def host_of(url: Column) -> Column:
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    return F.when(F.instr(url, "://") > 0, ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0))).otherwise("")


def path_of(url: Column) -> Column:
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule = verdict = F.lit(None).cast("string")
    for what, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        rule = F.when(fits, rule_host + rule_path).otherwise(rule)
        verdict = F.when(fits, what).otherwise(verdict)
    return rule, verdict


def segment_shape(segment: Column) -> Column:
    """A segment with its variable parts as wildcards."""
    stem = F.regexp_replace(segment, r"\.[A-Za-z][A-Za-z0-9]{0,4}$", "")
    end = F.regexp_extract(segment, r"\.[A-Za-z][A-Za-z0-9]{0,4}$", 0)
    kind = (
        F.when(stem.rlike(r"^[0-9]+$"), "{n}")
        .when(stem.rlike(r"^[0-9]{1,4}([-_.][0-9]{1,4})+$"), "{date}")
        .when(stem.rlike(r"^[0-9a-fA-F-]{16,}$"), "{id}")
        .when((F.length(stem) > 40) | stem.rlike(r"[0-9].*[0-9].*[0-9].*[0-9]"), "{id}")
        .otherwise(stem)
    )
    return F.concat(kind, end)


def content(html: Column) -> tuple[Column, Column]:
    """(characters of text, those in links) of a page, white space not counted."""
    plain = F.regexp_replace(html, UNSEEN, "")
    size = lambda c: F.length(F.regexp_replace(c, TAG_OR_SPACE, ""))
    return size(plain), size(F.array_join(F.regexp_extract_all(plain, F.lit(LINK), F.lit(1)), ""))


UNSEEN = r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->"
TAG_OR_SPACE = r"<[^>]*>|[\x20\t\n\r\f]+"
LINK = r"(?is)<a\b[^>]*>(.*?)</a>"


def tree(templates: DataFrame, p: TreeParams = TreeParams()) -> DataFrame:
    """``host, shape, template, bad_share`` of ``templates(host, seg, lab, bad)``, level by level."""
    state = templates.select("host", "seg", "lab", "bad", F.lit("").alias("t"), F.lit(False).alias("done"))
    deepest = templates.agg(F.max(F.size("seg"))).first()[0] or 0
    done, rate = None, F.col("a_bad") / F.col("a_lab")
    for d in range(deepest + 1):
        open_ = state.where("NOT done").withColumn("s", F.coalesce(F.get("seg", F.lit(d)), F.lit("")))
        own = open_.groupBy("host", "t", "s").agg(F.sum("lab").alias("b_lab"), F.sum("bad").alias("b_bad"))
        every = own.groupBy("host", "t").agg(F.sum("b_lab").alias("a_lab"), F.sum("b_bad").alias("a_bad"))
        apart = F.abs(F.col("b_bad") / F.col("b_lab") - rate) > p.z * F.sqrt(rate * (1 - rate) / F.col("b_lab")) + 0.05
        few = F.col("a_lab") < p.min_labelled
        branch = F.when(F.col("s") == "", "").when(few, "/{rest}").when((F.col("b_lab") >= p.min_labelled) & apart, F.concat(F.lit("/"), F.col("s"))).otherwise("/{any}")
        names = own.join(every, ["host", "t"]).select("host", "t", "s", branch.alias("branch"), ((F.col("s") == "") | few).alias("leaf"))
        # A host's templates are dealt out by their paths, so a large one isn't one key.
        names = names.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(p.salts - 1))))
        open_ = open_.withColumn("salt", F.pmod(F.xxhash64("seg"), F.lit(p.salts)).cast("int"))
        found = cut(open_.join(names, ["host", "t", "s", "salt"]).select("host", "seg", "lab", "bad", F.concat("t", "branch").alias("t"), F.col("leaf").alias("done")))
        leaves = found.where("done")
        done = leaves if done is None else done.unionByName(leaves)
        state = found
        if found.where("NOT done").isEmpty():
            break
    if done is None:
        done = state
    share = (F.sum("bad") + F.lit(p.strength * p.prior)) / (F.sum("lab") + F.lit(p.strength))
    shares = done.groupBy("host", "t").agg(share.alias("bad_share"))
    rows = done.withColumn("salt", F.pmod(F.xxhash64("seg"), F.lit(p.salts)).cast("int"))
    shares = shares.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(p.salts - 1))))
    return rows.join(shares, ["host", "t", "salt"]).select("host", F.array_join("seg", "/").alias("shape"), F.concat("host", "t").alias("template"), "bad_share")


def filter_urls(pages: DataFrame, rules=RULES, seed_words=SEED_WORDS, params: TreeParams = TreeParams()) -> DataFrame:
    """``page_id, host, path, rule, verdict, template, bad_share`` for every row of ``pages``.

    Rules decide first; the tree decides the rest. It works on counted templates, so pages that differ only in
    values cost one row."""
    p = params
    html = F.col("html") if "html" in pages.columns else F.lit(None).cast("string")
    size, links = content(html)
    read = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.struct(size.alias("n"), links.alias("l")).alias("page"))
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    seeded = F.lit(False)
    for word in seed_words:
        seeded = seeded | F.contains(F.col("host"), F.lit(word))
    shapes = F.transform(F.filter(F.split(F.col("path"), "/"), lambda s: s != ""), segment_shape)
    bad_page = (F.col("page.n") < p.thin) | (F.col("page.l") >= p.links * F.col("page.n"))
    rows = read.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("by_rule"), shapes.alias("seg"), F.when(seeded, True).otherwise(bad_page).alias("bad_page"))
    bad = F.when(F.col("by_rule").isNotNull(), F.col("by_rule") == "block").otherwise(F.col("bad_page"))
    rows = cut(rows.select("page_id", "host", "path", "rule", "by_rule", "seg", bad.alias("label")))
    templates = cut(rows.groupBy("host", "seg").agg(F.count("label").alias("lab"), F.count_if("label").alias("bad")))
    judged = tree(templates, p).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(p.salts - 1))))
    rows = rows.withColumn("shape", F.array_join("seg", "/")).withColumn("salt", F.pmod(F.xxhash64("page_id", "path"), F.lit(p.salts)).cast("int"))
    found = F.when(F.col("bad_share") >= p.reject_at, "block").otherwise("allow")
    return rows.join(judged, ["host", "shape", "salt"], "left").select(
        "page_id", "host", "path", "rule", F.coalesce(F.col("by_rule"), found).alias("verdict"), "template", F.round("bad_share", 6).alias("bad_share")
    )


def oracle(rules=RULES, seed_words=SEED_WORDS, params: TreeParams = TreeParams(), levels: int = 5) -> str:
    """The same in DuckDB SQL, for paths of fewer than ``levels`` segments."""
    p = params
    rule = "".join(
        f" WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{q}') THEN {{{i}}}"
        for i, (_, h, q) in sorted(enumerate(rules), key=lambda x: -len(x[1][1] + x[1][2]))
    )
    case = lambda f: "CASE" + rule.format(*[f"'{f(r)}'" for r in rules]) + " END"
    ext = r"\.[A-Za-z][A-Za-z0-9]{0,4}$"
    stem = f"regexp_replace(s, '{ext}', '')"
    shape = (
        f"CASE WHEN regexp_matches({stem}, '^[0-9]+$') THEN '{{n}}' WHEN regexp_matches({stem}, '^[0-9]{{1,4}}([-_.][0-9]{{1,4}})+$') THEN '{{date}}' "
        f"WHEN regexp_matches({stem}, '^[0-9a-fA-F-]{{16,}}$') OR length({stem}) > 40 OR regexp_matches({stem}, '[0-9].*[0-9].*[0-9].*[0-9]') THEN '{{id}}' ELSE {stem} END "
        f"|| regexp_extract(s, '{ext}')"
    )
    size = lambda c: f"length(regexp_replace({c}, '{TAG_OR_SPACE}', '', 'g'))"
    sql = f"""WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest, regexp_replace(html, '{UNSEEN}', '', 'g') AS x FROM pages),
hp AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path,
  {size('x')} AS n, {size(f"array_to_string(regexp_extract_all(x, '{LINK}', 1), '')")} AS l FROM u),
r AS (SELECT *, {case(lambda r: r[1] + r[2])} AS rule, {case(lambda r: r[0])} AS by_rule, {' OR '.join(f"contains(host, '{w}')" for w in seed_words)} AS seeded FROM hp),
s AS (SELECT page_id, host, path, rule, by_rule, list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''), lambda s: {shape}) AS seg,
  CASE WHEN by_rule IS NOT NULL THEN by_rule = 'block' WHEN seeded THEN true ELSE n < {p.thin} OR l >= {p.links}::DOUBLE * n END AS label FROM r),
l0 AS (SELECT host, seg, count(label) AS lab, count(*) FILTER (label) AS bad, '' AS t, false AS done FROM s GROUP BY host, seg)"""
    for d in range(1, levels + 1):
        sql += f""",
o{d} AS (SELECT host, t, coalesce(seg[{d}], '') AS s, sum(lab) AS b_lab, sum(bad) AS b_bad FROM l{d - 1} WHERE NOT done GROUP BY ALL),
e{d} AS (SELECT *, sum(b_lab) OVER w AS a_lab, sum(b_bad) OVER w AS a_bad FROM o{d} WINDOW w AS (PARTITION BY host, t)),
m{d} AS (SELECT host, t, s, s = '' OR a_lab < {p.min_labelled} AS leaf, CASE WHEN s = '' THEN '' WHEN a_lab < {p.min_labelled} THEN '/{{rest}}'
  WHEN b_lab >= {p.min_labelled} AND abs(b_bad::DOUBLE / b_lab - a_bad::DOUBLE / a_lab) > {p.z}::DOUBLE * sqrt(a_bad::DOUBLE / a_lab * (1 - a_bad::DOUBLE / a_lab) / b_lab) + 0.05::DOUBLE THEN '/' || s ELSE '/{{any}}' END AS branch FROM e{d}),
l{d} AS (SELECT * FROM l{d - 1} WHERE done UNION ALL SELECT l.host, l.seg, lab, bad, l.t || branch, leaf FROM l{d - 1} l JOIN m{d} m ON NOT l.done AND l.host = m.host AND l.t = m.t AND coalesce(l.seg[{d}], '') = m.s)"""
    return sql + f""",
g AS (SELECT host, t, (sum(bad) + {p.strength * p.prior}::DOUBLE) / (sum(lab) + {p.strength}::DOUBLE) AS bad_share FROM l{levels} GROUP BY ALL),
j AS (SELECT host, seg, host || t AS template, bad_share FROM l{levels} JOIN g USING (host, t))
SELECT page_id, host, path, rule, coalesce(by_rule, CASE WHEN bad_share >= {p.reject_at} THEN 'block' ELSE 'allow' END) AS verdict, template, round(bad_share, 6) AS bad_share
FROM s LEFT JOIN j USING (host, seg)"""
