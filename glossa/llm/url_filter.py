"""URL filtering by host rules and path-template trees.

Rules (host, path) fit their host and its subdomains where the url's path
starts with the rule's; the longest host wins, then the longest path. Urls that
a rule decides are also the labelled examples of the trees.

A tree stands for each host, each registered domain (the host's last two names)
and the whole corpus. Path segments become shapes (digits, hex ids and long
tokens turn into '*'); a branching point with many different children, each
rarely seen, becomes a wildcard; labelled siblings whose block rate does not
differ from their pooled rate are merged into one branch '~'. A branch ends, and
takes all below it as '**', where it has no labels, or the same one on every url,
or fewer urls than SUPPORT; trees grow level by level until all branches have
ended.

A template's purity is its smoothed share of blocked labels, (blocked + SMOOTH *
prior) / (labelled + SMOOTH). In the corpus tree a domain has one vote, its own share
of blocked labels in a branch, and a branch with votes of fewer than VOTERS domains
says nothing: one site's rule is no evidence about another. Its purity is (votes +
prior) / (domains + 1), the prior that of the branch above or, at first, the mean of
the domains' own block rates, one half at most; without enough votes it is the prior. The domain template's prior
is the corpus purity of the url's shape and the host's is the domain's, so that a
domain with few labels or none goes by what several others say of the same shape.
From REJECT on a template is rejected.

All work is grouping and joining on (tree, prefix): counts are combined before
every shuffle, and the joins have one row a key on one side, which Spark may
split where a host, or the corpus, is hot.

Defined cases: null urls, or urls without '://', have empty host and path, fit
no rule and are judged like any template; a very long url is a few more levels
at most; repeated rows are judged each; ties of rules go by their text; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.session import cut, small_side

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
SUPPORT = 8  # urls of a branch that may be split further
MANY, RARE = 12, 4.0  # a wildcard: so many children, seen so often on average at most
SMOOTH, REJECT, ALIKE = 4.0, 0.75, 2.0
VOTERS = 2  # labelled domains from which on a corpus template says something
SCOPES = ("corpus", "domain", "host")


def url_host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def match_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The rule's text and verdict, both null where none fits."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0]), len(r[1]), r)):
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        text, verdict = F.when(fits, h + p).otherwise(text), F.when(fits, v).otherwise(verdict)
    return text, verdict


def registered_domain(host: Column) -> Column:
    """The host's last two names, or all of a shorter one."""
    return F.regexp_extract(host, r"([^.]*\.)?[^.]*$", 0)


def path_shape(path: Column) -> Column:
    """The path's segments with variable parts as '*'."""
    bare = F.regexp_replace(path, "^/+|/+$", "")
    plain = F.regexp_replace(bare, r"(^|/)([0-9a-fA-F]{8,}|[^/]{40,})(?=/|$)", "$1*")
    return F.split(F.regexp_replace(plain, "[0-9]+", "*"), "/+")


COUNTS = ("n", "labelled", "blocked")


def _splits(n: Column, labelled: Column, blocked: Column) -> Column:
    """Whether a branch goes on: it has support and labels, and these differ or some
    urls have none."""
    return (n >= SUPPORT) & (labelled > 0) & ((labelled < n) | ((blocked > 0) & (blocked < labelled)))


def _smoothed(prior: Column, blocked: str, labelled: str) -> Column:
    return (F.col(blocked) + SMOOTH * prior) / (F.col(labelled) + SMOOTH)


def grow_tree(shapes: DataFrame, prior: Column) -> DataFrame:
    """shapes(key, shape, n, labelled, blocked) as (key, shape, template, labelled,
    blocked, pooled): the template each shape ends in, that template's labels and
    its purity smoothed by the branches above."""
    sums = [F.sum(c).alias(c) for c in COUNTS]
    roots = shapes.groupBy("key").agg(*sums)
    going = roots.select("key", _splits(*map(F.col, COUNTS)).alias("open"), *[F.col(c).alias(f"of_{c}") for c in COUNTS])
    tree = shapes.join(small_side(going, going.count()), "key").withColumn("template", F.lit(""))
    tree = cut(tree.withColumn("pooled", _smoothed(prior, "of_blocked", "of_labelled")))
    level, done = 0, []
    while True:
        whole = F.col("open") & (F.size("shape") > level)
        ends = F.when(F.size("shape") > level, F.concat("template", F.lit("/**"))).otherwise(F.col("template"))
        done.append(tree.where(~whole).select("key", "shape", ends.alias("template"), F.col("of_labelled").alias("labelled"), F.col("of_blocked").alias("blocked"), "pooled"))
        rows = tree.where(whole).select("key", "shape", *COUNTS, "template", "pooled", F.get("shape", F.lit(level)).alias("child"))
        if rows.isEmpty():
            return reduce(DataFrame.unionByName, done)
        at = ["key", "template"]
        children = cut(rows.groupBy(*at, "child").agg(*sums))
        points = children.groupBy(*at).agg(F.count(F.lit(1)).alias("fan"), F.sum("n").alias("seen"), F.sum("labelled").alias("all_labelled"), F.sum("blocked").alias("all_blocked"))
        rate = F.col("all_blocked") / F.col("all_labelled")
        spread = F.sqrt(rate * (1 - rate) / F.col("labelled"))
        alike = (F.col("labelled") > 0) & (F.col("labelled") < F.col("all_labelled")) & (F.abs(F.col("blocked") / F.col("labelled") - rate) <= ALIKE * spread)
        branch = F.when((F.col("fan") >= MANY) & (F.col("seen") <= RARE * F.col("fan")), "*").when(alike, "~").otherwise(F.col("child"))
        named = cut(children.join(small_side(points, points.count()), at).select(*at, "child", *COUNTS, F.concat("template", F.lit("/"), branch).alias("longer")))
        branches = named.groupBy("key", "longer").agg(*sums).select("key", "longer", _splits(*map(F.col, COUNTS)).alias("open"), *[F.col(c).alias(f"of_{c}") for c in COUNTS])
        placed = named.select(*at, "child", "longer").join(small_side(branches, branches.count()), ["key", "longer"])
        grown = rows.join(small_side(placed, placed.count()), [*at, "child"]).drop("template", "child").withColumnRenamed("longer", "template")
        tree = cut(grown.withColumn("pooled", _smoothed(F.col("pooled"), "of_blocked", "of_labelled")))
        level += 1


def domain_votes(keyed: DataFrame, grown: DataFrame, prior: Column) -> DataFrame:
    """(shape, pooled) of the corpus tree: the purity of each shape's template, by one
    vote a domain. Each branch on the way to the template with enough votes smooths them
    by the purity of the one before it."""
    parts = F.split("template", "/")
    branches = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(k.alias("level"), F.array_join(F.slice(parts, F.lit(1), k), "/").alias("branch")))
    templates = cut(grown.select("shape", "template"))
    ways = templates.select("template").distinct().select("template", F.inline(branches))
    labels = keyed.where("labelled > 0").groupBy("domain", "shape").agg(F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"))
    own = labels.join(templates, "shape").groupBy("template", "domain").agg(F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"))
    shares = own.join(ways, "template").groupBy("branch", "domain").agg((F.sum("blocked") / F.sum("labelled")).alias("share"))
    votes = shares.groupBy("branch").agg(F.count(F.lit(1)).alias("domains"), F.sum("share").alias("votes")).where(F.col("domains") >= VOTERS)
    heard = ways.join(votes, "branch").groupBy("template").agg(F.sort_array(F.collect_list(F.struct("level", "domains", "votes"))).alias("line"))
    pooled = F.aggregate(F.coalesce("line", F.array().cast("array<struct<level:int,domains:bigint,votes:double>>")), prior, lambda above, x: (x["votes"] + above) / (x["domains"] + 1))
    return templates.join(small_side(heard, templates.count()), "template", "left").select("shape", pooled.alias("pooled"))


def _purities(shapes: DataFrame, prior: Column) -> DataFrame:
    """(host, shape) with its host template and purity: corpus, domain and host trees,
    each the prior of the next."""
    keyed = shapes.withColumns({"corpus": F.lit(""), "domain": registered_domain(F.col("host"))})
    out = keyed.select(*SCOPES, "shape").withColumn("purity", prior)
    for scope in SCOPES:
        sums = cut(keyed.groupBy(F.col(scope).alias("key"), "shape").agg(*[F.sum(c).alias(c) for c in COUNTS]))
        grown = cut(grow_tree(sums, prior)).withColumnRenamed("key", scope)
        if scope == "corpus":
            heard = cut(domain_votes(keyed, grown, prior))
            out = out.join(small_side(heard, heard.count()), "shape").select(*SCOPES, "shape", F.col("pooled").alias("purity"))
            continue
        joined = out.join(small_side(grown, grown.count()), [scope, "shape"])
        out = joined.select(*SCOPES, "shape", _smoothed(F.col("purity"), "blocked", "labelled").alias("purity"), *(["template"] if scope == "host" else []))
    return out.select("host", "shape", "template", "purity")


def filter_urls(pages: DataFrame, *, page_id="page_id", url="url", rules=RULES, taught: Column | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity, method (the method's own
    verdict): one row for each url. taught limits the urls (by host and path)
    whose rules are examples."""
    host, path = url_host(F.col(url)), url_path(F.col(url))
    parsed = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = match_rule(F.col("host"), F.col("path"), rules)
    judged = parsed.withColumn("rule", rule).withColumn("by_rule", verdict).withColumn("shape", path_shape(F.col("path")))
    label = F.when(taught if taught is not None else F.lit(True), F.col("by_rule"))
    shapes = cut(judged.groupBy("host", "shape").agg(F.count(F.lit(1)).alias("n"), F.count(label).alias("labelled"), F.count_if(F.coalesce(label, F.lit("")) == "block").alias("blocked")))
    rates = shapes.where("labelled > 0").groupBy(registered_domain(F.col("host")).alias("domain")).agg((F.sum("blocked") / F.sum("labelled")).alias("rate"))
    n, summed = rates.agg(F.count(F.lit(1)), F.sum("rate")).first()
    prior = F.lit(min(0.5, ((summed or 0) + 1.0) / (n + 2.0)))
    verdicts = cut(_purities(shapes, prior))
    judged = judged.join(small_side(verdicts, shapes.count()), ["host", "shape"])
    own = F.when(F.col("purity") >= REJECT, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("by_rule", own).alias("verdict"), "template", "purity", own.alias("method"))


def _tree_sql(scope: str, key: str, levels: int = 3) -> str:
    """A tree's levels as SQL; levels is as deep as any branch of the tables goes."""
    sums = "sum(n) AS n, sum(labelled) AS labelled, sum(blocked) AS blocked"
    splits = f"n >= {SUPPORT} AND labelled > 0 AND (labelled < n OR (blocked > 0 AND blocked < labelled))"
    t = lambda k: f"{scope}_t{k}"
    smooth = lambda above, of: f"({of}blocked + {SMOOTH}::DOUBLE * {above}) / ({of}labelled + {SMOOTH}::DOUBLE)"
    parts = [f"""
{scope}_s AS (SELECT {key} AS key, shape, {sums} FROM shapes GROUP BY ALL),
{scope}_roots AS (SELECT key, {splits} AS open, labelled AS of_labelled, blocked AS of_blocked FROM (SELECT key, {sums} FROM {scope}_s GROUP BY key)),
{t(0)} AS (SELECT s.*, open, of_labelled, of_blocked, '' AS template, {smooth("prior", "of_")} AS pooled FROM {scope}_s s JOIN {scope}_roots USING (key) CROSS JOIN prior)"""]
    for k in range(1, levels + 1):
        parts.append(f"""
{scope}_children{k} AS (SELECT key, template, shape[{k}] AS child, {sums} FROM {t(k - 1)} WHERE open AND len(shape) >= {k} GROUP BY ALL),
{scope}_points{k} AS (SELECT key, template, count(*) AS fan, sum(n) AS seen, sum(labelled) AS all_labelled, sum(blocked) / nullif(sum(labelled), 0) AS pooled FROM {scope}_children{k} GROUP BY ALL),
{scope}_named{k} AS (SELECT c.*, c.template || '/' || CASE WHEN fan >= {MANY} AND seen <= {RARE}::DOUBLE * fan THEN '*'
    WHEN labelled > 0 AND labelled < all_labelled AND abs(blocked / nullif(labelled, 0) - pooled) <= {ALIKE}::DOUBLE * sqrt(pooled * (1 - pooled) / nullif(labelled, 0)) THEN '~' ELSE child END AS longer FROM {scope}_children{k} c JOIN {scope}_points{k} USING (key, template)),
{scope}_branches{k} AS (SELECT key, longer, {splits} AS open, labelled AS of_labelled, blocked AS of_blocked FROM (SELECT key, longer, {sums} FROM {scope}_named{k} GROUP BY ALL)),
{t(k)} AS (SELECT t.key, t.shape, t.n, t.labelled, t.blocked, b.open, b.of_labelled, b.of_blocked, n.longer AS template, {smooth("t.pooled", "b.of_")} AS pooled FROM {t(k - 1)} t
  JOIN {scope}_named{k} n ON t.open AND len(t.shape) >= {k} AND t.key = n.key AND t.template = n.template AND t.shape[{k}] = n.child JOIN {scope}_branches{k} b ON b.key = n.key AND b.longer = n.longer)""")
    ended = " UNION ALL ".join(
        f"SELECT key, shape, CASE WHEN len(shape) > {k} THEN template || '/**' ELSE template END AS template, of_labelled AS labelled, of_blocked AS blocked, pooled FROM {t(k)}" + (f" WHERE NOT (open AND len(shape) > {k})" if k < levels else "") for k in range(levels + 1)
    )
    parts.append(f"\n{scope}_tree AS ({ended})")
    return ",".join(parts)


def oracle(rules=RULES) -> str:
    ranked = sorted(rules, key=lambda r: (len(r[0]), len(r[1]), r), reverse=True)
    fits = [(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN", h + p, v) for h, p, v in ranked]
    rule, verdict = (" ".join(f"{f[0]} '{f[k]}'" for f in fits) for k in (1, 2))
    keys = {"corpus": "''", "domain": "regexp_extract(host, '([^.]*[.])?[^.]*$')", "host": "host"}
    smooth = lambda tree, prior: f"({tree}.blocked + {SMOOTH}::DOUBLE * {prior}) / ({tree}.labelled + {SMOOTH}::DOUBLE)"
    return rf"""
WITH parsed AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
    regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
judged AS (
  SELECT *, CASE {rule} END AS rule, CASE {verdict} END AS by_rule,
    list_transform(string_split_regex(regexp_replace(path, '^/+|/+$', '', 'g'), '/+'),
      lambda s: CASE WHEN regexp_full_match(s, '[0-9a-fA-F]{{8,}}|[^/]{{40,}}') THEN '*' ELSE regexp_replace(s, '[0-9]+', '*', 'g') END) AS shape FROM parsed),
shapes AS MATERIALIZED (
  SELECT host, shape, count(*) AS n, count(rule) AS labelled, count(*) FILTER (WHERE by_rule = 'block') AS blocked FROM judged GROUP BY host, shape),
by_domain AS MATERIALIZED (SELECT {keys["domain"]} AS domain, shape, sum(labelled) AS labelled, sum(blocked) AS blocked FROM shapes WHERE labelled > 0 GROUP BY ALL),
prior AS (
  SELECT least(0.5::DOUBLE, (coalesce(sum(rate), 0) + 1.0::DOUBLE) / (count(*) + 2.0::DOUBLE)) AS prior FROM (SELECT sum(blocked) / sum(labelled) AS rate FROM by_domain GROUP BY domain)),{",".join(_tree_sql(k, v) for k, v in keys.items())},
ways AS (
  SELECT template, level, array_to_string(string_split(template, '/')[1:level], '/') AS branch FROM (SELECT template, unnest(range(1, len(string_split(template, '/')) + 1)) AS level FROM (SELECT DISTINCT template FROM corpus_tree))),
votes AS (
  SELECT branch, count(*) AS domains, sum(share) AS votes FROM (
    SELECT branch, domain, sum(b.blocked) / sum(b.labelled) AS share FROM by_domain b JOIN corpus_tree t ON t.shape = b.shape JOIN ways USING (template) GROUP BY ALL) GROUP BY branch HAVING count(*) >= {VOTERS}),
lines AS (SELECT template, list([domains::DOUBLE, votes] ORDER BY level) AS line FROM ways JOIN votes USING (branch) GROUP BY template),
heard AS (SELECT shape, list_reduce(list_prepend([0, prior], coalesce(line, [])), lambda a, x: [0, (x[2] + a[2]) / (x[1] + 1)])[2] AS pooled FROM corpus_tree LEFT JOIN lines USING (template) CROSS JOIN prior),
purities AS (
  SELECT s.host, s.shape, h.template, {smooth("h", smooth("d", "c.pooled"))} AS purity FROM shapes s
  JOIN heard c ON c.shape = s.shape JOIN domain_tree d ON d.shape = s.shape AND d.key = {keys["domain"].replace("host", "s.host")} JOIN host_tree h ON h.shape = s.shape AND h.key = s.host)
SELECT page_id, host, path, rule, coalesce(by_rule, CASE WHEN purity >= {REJECT} THEN 'block' ELSE 'allow' END) AS verdict, template, purity, CASE WHEN purity >= {REJECT} THEN 'block' ELSE 'allow' END AS method
FROM judged JOIN purities USING (host, shape)
"""
