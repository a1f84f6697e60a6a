"""URL filters: allow and block rules by host and path; what no rule tells is judged by a character language-model ratio.

The URLs that the rules tell teach two smoothed variable-order Markov models, of accepted and of rejected URLs. A URL's
score is its log-likelihood under the first less that under the second, by character; the threshold is calibrated on
a fifth of the told URLs, which no model has seen. Everything is DataFrame functions: each URL is exploded into one
gram a character (its K characters before and itself), counts of shorter contexts are sums over that table of distinct grams.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vertexlens.functions.rng import uniform, uniform_sql
from vertexlens.llm.frames import cut_lineage, table
from vertexlens.llm.lookup import floor_div, with_values

_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: Marks before the first and after the last character of a URL.
_FIRST, _LAST = "\x02", "\x03"


@dataclass(frozen=True)
class Rule:
    """allow or block, for a host with all its subdomains, if the path starts with `path`."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: Fixed values of the query.
RULES = (Rule("allow", "com", "/"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"), Rule("block", "net", "/es/"), Rule("block", "net", "/fr/"))


@dataclass(frozen=True)
class UrlParams:
    """Contexts of up to `order` characters that the class has met `least` times; characters are `alphabet` at first.

    `held` of the told URLs calibrate, drawn by hash; scores are micro-nats a character, thresholds multiples of `step`.
    """

    order: int = 5
    least: int = 2
    alphabet: int = 256
    held: float = 0.2
    step: int = 1000
    seed: int = 42


def lowered(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def host_and_path(url: str) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path as the module's contract has them; empty where url is null or has no `://`."""
    part = lambda i: F.coalesce(F.regexp_extract(url, _URL, i), F.lit(""))
    return lowered(part(1)), part(2)


def judged(pages: DataFrame, rules: tuple[Rule, ...], url: str = "url") -> DataFrame:
    """pages with host, path, rule, told (the rule's verdict; both null if none fits) and form, what the models read of the URL.

    Of the rules that fit the longest wins; of equally long ones that of the longer host, then the first. form is the URL
    after its first `://`, or all of it, A-Z lower-cased; empty for null. Columns of these names are replaced.
    """
    host, path = host_and_path(url)
    at = F.instr(url, "://")
    form = F.coalesce(lowered(F.when(at > 0, F.substr(F.col(url), at + 3)).otherwise(F.col(url))), F.lit(""))
    rows = pages.withColumns({"host": host, "path": path, "form": form})
    rule, told = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(reversed(rules), key=lambda r: (len(r.name), len(r.host))):
        fits = ((F.col("host") == r.host) | F.endswith(F.col("host"), F.lit("." + r.host))) & F.startswith(F.col("path"), F.lit(r.path))
        rule, told = F.when(fits, r.name).otherwise(rule), F.when(fits, r.verdict).otherwise(told)
    return rows.withColumns({"rule": rule, "told": told})


def grams(forms: DataFrame, order: int) -> DataFrame:
    """forms with gram: one row for each character and for the end, with the `order` characters before; work is linear in the length."""
    chars = F.split(F.concat(F.lit(_FIRST * order), "form", F.lit(_LAST)), "")
    rows = forms.withColumn("_c", chars)
    at = F.sequence(F.lit(1), F.size("_c") - order)
    gram = F.transform(at, lambda i: F.concat(*(F.element_at("_c", i + j) for j in range(order + 1))))
    return rows.withColumn("gram", F.explode(gram)).drop("_c")


def gram_ratios(counts: DataFrame, p: UrlParams) -> DataFrame:
    """(gram, uses, bits) of counts(gram, uses, na, nr): micro-nats by which the accepted model finds its last character likelier.

    A model's probability after a context is (n + t q) / (N + t): n of N times the character came next, t different
    ones did, and q is the probability after the context without its first character. A context with N < least, an
    unseen one above all, gives q as it is: the order varies with what has been seen.
    """
    level = {p.order: counts.select("gram", "uses", "na", "nr")}
    for j in range(p.order - 1, -1, -1):
        level[j] = level[j + 1].groupBy(F.substring("gram", 2, j + 1).alias("gram")).agg(F.sum("na").alias("na"), F.sum("nr").alias("nr"))
    known = None
    for j in range(p.order + 1):
        own = Window.partitionBy(F.substring("gram", 1, j))  # as many rows as characters that may come next
        row = level[j].select(
            "*", *(F.sum(n).over(own).cast("double").alias(f"N{n}") for n in ("na", "nr")), *(F.count_if(F.col(n) > 0).over(own).cast("double").alias(f"t{n}") for n in ("na", "nr"))
        ).withColumn("tail", F.substring("gram", 2, j))
        if known is None:
            row = row.withColumns({f"q{n}": F.lit(1.0 / p.alphabet) for n in ("na", "nr")})
        else:
            row = row.join(known.select(F.col("gram").alias("tail"), F.col("pna").alias("qna"), F.col("pnr").alias("qnr")), "tail")
        prob = lambda n: F.when(F.col(f"N{n}") >= p.least, (F.col(n).cast("double") + F.col(f"t{n}") * F.col(f"q{n}")) / (F.col(f"N{n}") + F.col(f"t{n}"))).otherwise(F.col(f"q{n}"))
        known = row.withColumns({f"p{n}": prob(n) for n in ("na", "nr")})
    return known.select("gram", "uses", F.floor(F.lit(1e6) * (F.log("pna") - F.log("pnr"))).alias("bits"))


def url_scores(forms: DataFrame, p: UrlParams = UrlParams()) -> DataFrame:
    """(form, told, n, held, score) of forms(form, told, n): distinct pairs of a URL and a verdict (null: none) with its n rows.

    The models learn from told rows that are not held, each as often as it occurs.
    """
    held = uniform(p.seed, "form") < p.held
    rows = forms.withColumn("held", held)
    learns = lambda verdict: F.coalesce(F.sum(F.when((F.col("told") == verdict) & ~F.col("held"), F.col("n"))), F.lit(0))
    counts = cut_lineage(grams(rows, p.order).groupBy("gram").agg(F.count(F.lit(1)).alias("uses"), learns("allow").alias("na"), learns("block").alias("nr")))
    ratios = cut_lineage(gram_ratios(counts, p))
    wanted = grams(rows.where("told is null or held"), p.order)
    found = with_values(wanted, ratios, "gram").groupBy("form", "told").agg(F.first("n").alias("n"), F.first("held").alias("held"), F.sum("bits").alias("bits"), F.count(F.lit(1)).alias("m"))
    return found.select("form", "told", "n", "held", floor_div(F.col("bits"), F.col("m")).alias("score"))


def threshold(scores: DataFrame, p: UrlParams = UrlParams()) -> int:
    """The least multiple of `step` that is a score's and maximises the share of held accepted rows at or above it plus that of rejected ones below.

    0 without both kinds. It comes from a histogram of scores, of which there are as many as log-ratios differ by a step.
    """
    kinds = scores.where("held and told is not null").groupBy((F.col("score") - F.pmod("score", F.lit(p.step))).alias("at"))
    h = kinds.agg(F.sum(F.when(F.col("told") == "allow", F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("told") == "block", F.col("n")).otherwise(0)).alias("r"))
    before = Window.orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    h = h.select("at", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}0") for c in "ar"), F.sum("a").over(every).alias("aa"), F.sum("r").over(every).alias("rr"))
    gain = (F.col("aa") - F.col("a0")).cast("double") / F.col("aa") + F.col("r0").cast("double") / F.col("rr")
    best = h.where("aa > 0 and rr > 0").withColumn("gain", gain).orderBy(F.desc("gain"), "at").first()
    return 0 if best is None else best["at"]


def url_verdicts(pages: DataFrame, rules: tuple[Rule, ...] = RULES, p: UrlParams = UrlParams(), url: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, score of every row: the verdict of the rule, else `allow` if score is at least the threshold.

    score (micro-nats a character) is null where a rule tells. Null and empty URLs and those without `://` have empty
    host and path; they are scored as what they are, null as the empty one. Repeated rows stay repeated and are
    judged alike, a null page_id stays null, other columns are ignored. Without accepted or rejected URLs the
    threshold is 0, and without any all scores are 0, so all that no rule tells is allowed. An empty table gives no rows.
    """
    rows = judged(pages.select("page_id", F.col(url).alias("url")), rules).drop("url")
    forms = cut_lineage(rows.groupBy("form", "told").agg(F.count(F.lit(1)).alias("n")))
    scores = cut_lineage(url_scores(forms, p))
    least = threshold(scores, p)
    told = rows.where("told is not null").select("page_id", "host", "path", "rule", F.col("told").alias("verdict"), F.lit(None).cast("bigint").alias("score"))
    untold = with_values(rows.where("told is null").select("page_id", "host", "path", "rule", "form"), scores.where("told is null").select("form", "n", "score"), "form", "n")
    verdict = F.when(F.col("score") >= least, "allow").otherwise("block")
    return told.unionByName(untold.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score"))


def op11_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(table(spark, sf_dir, "pages"))


def _sql(rules: tuple[Rule, ...] = RULES, p: UrlParams = UrlParams()) -> str:
    low = lambda c: f"translate({c}, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    order = sorted(rules, key=lambda r: (-len(r.name), -len(r.host)))
    fits = lambda r: f"(host = '{r.host}' or ends_with(host, '.{r.host}')) and starts_with(path, '{r.path}')"
    pick = lambda what: "case " + " ".join(f"when {fits(r)} then '{getattr(r, what)}'" for r in order) + " end"
    k = p.order
    ctes = [
        f"u as (select page_id, coalesce(regexp_extract(url, '{_URL}', 1), '') as host, coalesce(regexp_extract(url, '{_URL}', 2), '') as path, coalesce(case when contains(url, '://') then substring(url, strpos(url, '://') + 3) else url end, '') as form from pages)",
        f"h as (select page_id, {low('host')} as host, path, {low('form')} as form from u)",
        f"j as (select *, {pick('name')} as rule, {pick('verdict')} as told from h)",
        f"f as materialized (select form, told, count(*) as n, {uniform_sql(p.seed, 'form')} < {p.held} as held from j group by form, told)",
        f"x as (select *, repeat(chr(2), {k}) || form || chr(3) as s, unnest(range(1, length(form) + 2)) as i from f)",
        f"g as materialized (select form, told, n, held, substring(s, i, {k + 1}) as gram from x)",
        f"c{k} as materialized (select gram, sum(case when told = 'allow' and not held then n else 0 end) as na, sum(case when told = 'block' and not held then n else 0 end) as nr from g group by gram)",
    ]
    ctes += [f"c{i} as (select substring(gram, 2) as gram, sum(na) as na, sum(nr) as nr from c{i + 1} group by 1)" for i in range(k - 1, -1, -1)]
    for i in range(k + 1):
        w = ", ".join(f"(sum({n}) over w)::double as N_{n}, (count(*) filter ({n} > 0) over w)::double as t_{n}" for n in ("na", "nr"))
        lower = f"join p{i - 1} q on q.gram = substring(d.gram, 2)" if i else ""
        q = (lambda n: f"q.p_{n}") if i else (lambda n: f"(1.0::double / {p.alphabet})")  # noqa: B023
        prob = ", ".join(f"case when N_{n} >= {p.least} then (d.{n}::double + t_{n} * {q(n)}) / (N_{n} + t_{n}) else {q(n)} end as p_{n}" for n in ("na", "nr"))
        ctes.append(f"p{i} as (select d.gram, {prob} from (select *, {w} from c{i} window w as (partition by left(gram, {i}))) d {lower})")
    ctes += [
        f"b as (select gram, floor(1e6::double * (ln(p_na) - ln(p_nr)))::bigint as bits from p{k})",
        "s as materialized (select form, told, any_value(n) as n, any_value(held) as held, floor(sum(bits) / count(*)::double)::bigint as score from g join b using (gram) where told is null or held group by form, told)",
        f"z as (select score - ((score % {p.step}) + {p.step}) % {p.step} as lo, sum(case when told = 'allow' then n else 0 end) as a, sum(case when told = 'block' then n else 0 end) as r from s where held and told is not null group by 1)",
        "y as (select lo, coalesce(sum(a) over b, 0) as a0, coalesce(sum(r) over b, 0) as r0, sum(a) over () as aa, sum(r) over () as rr from z window b as (order by lo rows between unbounded preceding and 1 preceding))",
        "l as (select coalesce((select lo from y where aa > 0 and rr > 0 order by (aa - a0)::double / aa + r0::double / rr desc, lo limit 1), 0) as least)",
    ]
    return f"with {', '.join(ctes)} select page_id, host, path, rule, coalesce(j.told, case when s.score >= least then 'allow' else 'block' end) as verdict, case when j.told is null then s.score end as score from j left join s on s.form = j.form and j.told is null and s.told is null, l"


OP11_SQL = _sql()
