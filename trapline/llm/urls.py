"""URL filters (1): rules first, then a path-template tree, with SQL only.

Urls are parsed into host and path.  A rule fits its host and all subdomains if
the path starts with the rule's; the longest rule decides, and what the rules
decide is the labelled evidence.  For all other urls, per host:

* path segments are the levels of a tree, as deep as the deepest path (the first three
  levels hold all urls, the fourth and further ones those that have such a segment;
  each level is a few small jobs), digits in a segment are generalised to ``#``;
* a level below a parent is a wildcard ``*`` where it has over 20 branches and
  more branches than half its pages;
* a branch whose pages are spread over next segments and labels as those of all
  its siblings are (chi-square within three standard deviations) is merged into
  the branch ``~``; the others keep their segment;
* a template's share of blocked labels is smoothed towards its parent's, from the
  whole table down to the template; it is rejected if that purity exceeds 0.75.

All counts are taken over (host, masked segments), which is far smaller than the
pages where segments differ by numbers, and about as many where they are worded; they
are partial aggregates joined back, so no host's rows are sorted in one task.  The
verdicts are joined back to the pages by that key.

Defined cases: a null url or one without ``://`` has an empty host and path and is
judged by the method like any host; empty segments are segments; repeated rows
are judged one by one and count one by one; an empty table gives an empty result;
other columns of ``pages`` are ignored.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from trapline.llm.tables import materialize, table

# fixed values: the rules of the contract (verdict, host, path)
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ROUNDING = 1e-9        # of the count: the test statistic of one cell is 0, but for the sum's rounding
MIN_BRANCHES = 20      # a level with more of them may be a wildcard
LEVELS = 3             # that all urls have, with empty segments where a path ends before
SMOOTHING = 4          # labels that a parent's purity counts as
MAX_BLOCKED = 0.75      # purity above which a template is rejected


def _case(value) -> str:
    """SQL for the longest rule that fits: value(verdict, rule)."""
    fits = lambda h, p: (f"(host = '{h}' OR right(host, {len(h) + 1}) = '.{h}') AND left(path, {len(p)}) = '{p}'")
    longest = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    return "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{value(v, h + p)}'" for v, h, p in longest) + " END"


def parsed_sql(pages: str, everywhere: str = "") -> str:
    """Pages with host, path, rule, label and masked segments; ``everywhere``: DuckDB's flag for all matches."""
    segment = lambda k: f"regexp_replace(split_part(path, '/', {k + 1}), '[0-9]+', '#'{everywhere}) AS s{k}"
    return f"""
SELECT page_id, host, path, rule, label, {segment(1)}, {segment(2)}, {segment(3)} FROM (
SELECT *, {_case(lambda v, r: r)} AS rule, {_case(lambda v, r: v)} AS label FROM (
SELECT page_id, translate(raw_host, '{UPPER}', '{LOWER}') AS host,
       regexp_extract(substr(rest, length(raw_host) + 1), '^[^?#]*', 0) AS path FROM (
SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*', 0) AS raw_host FROM (
SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
FROM {pages}) a) b) c) d"""


def shapes_sql(parsed: str) -> str:
    """Pages, allowed and blocked ones for each host and masked segments."""
    return f"""
SELECT host, s1, s2, s3, count(*) AS n, count(CASE WHEN label = 'allow' THEN 1 END) AS a,
       count(CASE WHEN label = 'block' THEN 1 END) AS b FROM {parsed} GROUP BY host, s1, s2, s3"""


def level_sql(rows: str, parent: tuple[str, ...], segment: str, child: str, token: str, joined: bool = False) -> str:
    """``rows`` with the template token of one level of the tree; ``joined``: no window, so that no parent's rows meet in one task."""
    up = ", ".join(("host", *parent))
    same = " AND ".join(f"x.{c} = y.{c}" for c in ("host", *parent))
    every = " AND ".join(f"x.{c} = y.{c}" for c in ("host", *parent, segment))
    cells = f"""SELECT {up}, {segment}, child, label, sum(c) AS c FROM (
                      SELECT {up}, {segment}, {child} AS child, 'a' AS label, a AS c FROM {rows}
                      UNION ALL SELECT {up}, {segment}, {child}, 'b', b FROM {rows}
                      UNION ALL SELECT {up}, {segment}, {child}, 'u', n - a - b FROM {rows}) q
                    WHERE c > 0 GROUP BY {up}, {segment}, child, label"""
    p, sums = f"sum(c) OVER (PARTITION BY {', '.join('x.' + c for c in ('host', *parent))}, x.child, x.label) AS p", ""
    if joined:
        p, sums = "o.p", f"""
              JOIN (SELECT {up}, child, label, sum(c) AS p FROM ({cells}) e GROUP BY {up}, child, label) o
                ON {same.replace("y.", "o.")} AND x.child = o.child AND x.label = o.label"""
    return f"""
SELECT x.*, y.{token} FROM {rows} x JOIN (
  SELECT x.*, CASE WHEN k > {MIN_BRANCHES} AND 2 * k > total THEN '*'
                   WHEN k > 1 AND x2 - n <= (cells - 1) + 3 * sqrt(2e0 * (cells - 1)) + {ROUNDING:e} * n THEN '~'
                   ELSE x.{segment} END AS {token}
  FROM (SELECT {up}, {segment}, sum(c) AS n, sum(1e0 * c * c * total / (1e0 * p * bn)) AS x2,
               min(k) AS k, min(total) AS total, min(cells) AS cells
        FROM (SELECT x.*, y.bn, z.k, z.total, z.cells, {p}
              FROM ({cells}) x
              JOIN (SELECT {up}, {segment}, sum(n) AS bn FROM {rows} GROUP BY {up}, {segment}) y ON {every}
              JOIN (SELECT {up}, count(DISTINCT {segment}) AS k, sum(n) AS total,
                           count(DISTINCT CASE WHEN a > 0 THEN {child} END) + count(DISTINCT CASE WHEN b > 0 THEN {child} END)
                           + count(DISTINCT CASE WHEN n > a + b THEN {child} END) AS cells
                    FROM {rows} GROUP BY {up}) z ON {same.replace("y.", "z.")}{sums}) w
        GROUP BY {up}, {segment}) x) y ON {every}"""


def verdicts_sql(shapes: str) -> str:
    """(host, s1, s2, s3, template, purity, verdict) of every shape, by the template tree."""
    purity = lambda b, a, above: f"({b} + {SMOOTHING} * {above}) / ({a} + {b} + {SMOOTHING})"
    total = lambda c, keys: f"1e0 * sum({c}) OVER (PARTITION BY {keys})"
    keys = ("host", "host, t1", "host, t1, t2", "host, t1, t2, t3")
    sums = ", ".join(f"{total('a', k)} AS a{i}, {total('b', k)} AS b{i}" for i, k in enumerate(keys))
    return f"""
SELECT host, s1, s2, s3, template, q4 AS purity, CASE WHEN q4 > {MAX_BLOCKED:e} THEN 'block' ELSE 'allow' END AS verdict FROM (
SELECT *, {purity("b3", "a3", "q3")} AS q4 FROM (
SELECT *, {purity("b2", "a2", "q2")} AS q3 FROM (
SELECT *, {purity("b1", "a1", "q1")} AS q2 FROM (
SELECT *, {purity("b0", "a0", "q0")} AS q1 FROM (
SELECT t.host, s1, s2, s3, host || '/' || t1 || '/' || t2 || '/' || t3 AS template, {sums},
       (SELECT (sum(b) + 1e0) / (sum(a) + sum(b) + 2e0) FROM {shapes}) AS q0 FROM (
{level_sql("l2", ("t1", "t2"), "s3", "''", "t3")}) t) v0) v1) v2) v3) v4"""


def _tree(shapes: str) -> tuple[str, str, str]:
    return level_sql(shapes, (), "s1", "s2", "t1"), level_sql("l1", ("t1",), "s2", "s3", "t2"), verdicts_sql(shapes)


RESULT = """
SELECT p.page_id, p.host, p.path, p.rule, coalesce(p.label, v.verdict) AS verdict, v.template, v.purity
FROM {parsed} p JOIN {verdicts} v ON p.host = v.host AND p.s1 = v.s1 AND p.s2 = v.s2 AND p.s3 = v.s3"""


def filter_urls(pages: DataFrame) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, purity) for every row of (page_id, url)."""
    spark = pages.sparkSession
    masked = "regexp_replace(path, '[0-9]+', '#') AS m"
    parsed = spark.sql(f"SELECT *, {masked} FROM ({parsed_sql('{pages}')})", pages=pages)
    # empty segments at the end make a path no deeper
    shapes = materialize(spark.sql("""
SELECT host, m, length(regexp_replace(rtrim('/', m), '[^/]', '')) AS depth, count(*) AS n, count(CASE WHEN label = 'allow' THEN 1 END) AS a,
       count(CASE WHEN label = 'block' THEN 1 END) AS b FROM {parsed} GROUP BY host, m""", parsed=parsed))
    total = shapes.agg({"a": "sum", "b": "sum", "depth": "max"}).first()
    a, b, deepest = (total[f"{f}({c})"] or 0 for f, c in (("sum", "a"), ("sum", "b"), ("max", "depth")))
    rows = _smoothed(spark.sql(f"SELECT *, host AS template, {(b + 1) / (a + b + 2)!r}D AS q FROM {{shapes}}", shapes=shapes))
    done = []
    for k in range(1, max(LEVELS, deepest) + 1):
        split = spark.sql(f"SELECT *, split_part(m, '/', {k + 1}) AS s, split_part(m, '/', {k + 2}) AS child FROM {{rows}}", rows=rows)
        # sums are joined, not windowed: one host may have about as many shapes as pages
        level = spark.sql(level_sql("{split}", ("template",), "s", "child", "t", joined=True), split=split)
        rows = _smoothed(materialize(level.selectExpr("host", "m", "depth", "n", "a", "b", "template || '/' || t AS template", "q")))
        if k >= LEVELS:  # the shapes that end here; the others go on among themselves
            done.append(rows.where(f"depth <= {k}"))
            rows = rows.where(f"depth > {k}")
    verdicts = reduce(DataFrame.union, done)
    return spark.sql(f"""
SELECT p.page_id, p.host, p.path, p.rule, coalesce(p.label, CASE WHEN q > {MAX_BLOCKED:e} THEN 'block' ELSE 'allow' END) AS verdict,
       v.template, v.q AS purity
FROM {{parsed}} p JOIN {{verdicts}} v ON p.host = v.host AND p.m = v.m""", parsed=parsed, verdicts=verdicts)


def _smoothed(rows: DataFrame) -> DataFrame:
    """``rows``, written, with q smoothed towards the parent's, which it was."""
    return materialize(rows.sparkSession.sql(f"""
SELECT t.host, m, depth, n, t.a, t.b, t.template, (1e0 * k.b + {SMOOTHING} * q) / (1e0 * k.a + 1e0 * k.b + {SMOOTHING}) AS q
FROM {{rows}} t JOIN (SELECT host, template, sum(a) AS a, sum(b) AS b FROM {{rows}} GROUP BY host, template) k
  ON t.host = k.host AND t.template = k.template""", rows=rows))


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"))


_ONE, _TWO, _VERDICTS = _tree("shapes")
OP1_SQL = (f"WITH parsed AS ({parsed_sql('pages', ", 'g'")}), shapes AS ({shapes_sql('parsed')}), l1 AS ({_ONE}), l2 AS ({_TWO}), "
           f"verdicts AS ({_VERDICTS}) {RESULT.format(parsed='parsed', verdicts='verdicts')}")
