"""Line dedup by site-relative frequency.

Contract: a document's host is its source (null is a host of its own), its lines are the parts
between line feeds, compared without white space at their ends. A page is a distinct text of a host,
so exact copies count once. A line is a candidate when at least ``min_pages`` of its host's pages
and more than ``ratio`` of all of them contain it. Near copies of one page would make each other's text
frequent, so pages vote: a page that consists by more than half (in characters of its distinct lines) of
candidates shares one vote with all such pages of its host that have the same longest candidate (ties: larger
md5), any other page has its own. A candidate is boilerplate when at least ``min_pages`` votes and more
than ``ratio`` of the host's votes contain it. Boilerplate lines go, the others stay in order, joined by one
line feed; blank lines are never boilerplate. A text that would lose over half of its characters consists of
what its site repeats and stays as it is. Null text stays null and has no lines. Repeated rows stay;
extra columns pass through, but ``n_lines`` and ``n_dropped`` of the input give way to those of the result
(``cleaned`` keeps them); an empty table gives an empty result.

Method: (host, line, page) is aggregated on 128-bit keys, so no text enters that shuffle and copies
collapse before it. A host has at most lines-per-page / ratio candidates, so what joins back to the pages is
small; adaptive execution may broadcast or split it. Only lists of a page's own boilerplate keys join the
documents, by a merge join at every size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import stored

#: A line on over a twentieth of a site's pages, and on at least five of them, belongs to the site and not to a page.
RATIO = 0.05
MIN_PAGES = 5
#: Fixed set of characters stripped from both ends of a line before it is compared.
ENDS = " \t\r\f\x0b"
N_LINES, N_DROPPED = "__line_dedup_n_lines", "__line_dedup_n_dropped"


def text_key(text: Column) -> Column:
    """128 bits of a text."""
    return F.unhex(F.md5(text))


def bare(line: Column) -> Column:
    return F.btrim(line, F.lit(ENDS))


def frequent(lines: DataFrame, pages: DataFrame, ratio: float, min_pages: int) -> DataFrame:
    """(host, line) of lines that enough pages hold, from rows (host, line, with_line) and (host, pages)."""
    joined = lines.where(F.col("with_line") >= min_pages).alias("c").join(pages.alias("t"), F.expr("c.host <=> t.host"))
    return stored(joined.where(F.col("with_line") > ratio * F.col("pages")).select("c.host", "c.line"))


def boilerplate(docs: DataFrame, ratio: float, min_pages: int) -> tuple[DataFrame, DataFrame]:
    """Occurrences (host, page, line) of candidate lines and the boilerplate keys (host, line) among them."""
    pages = docs.where("text IS NOT NULL").select(F.col("source").alias("host"), text_key(F.col("text")).alias("page"), "text")
    lines = F.array_distinct(F.filter(F.transform(F.split("text", "\n"), bare), lambda line: line != ""))
    found = pages.select("host", "page", F.explode(lines).alias("line")).select("host", "page", text_key(F.col("line")).alias("line"), F.char_length("line").alias("size"))
    found = stored(found.distinct())
    totals = stored(pages.select("host", "page").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("pages")))
    candidates = frequent(found.groupBy("host", "line").agg(F.count(F.lit(1)).alias("with_line")), totals, ratio, min_pages)
    hits = stored(found.alias("f").join(candidates.alias("d"), F.expr("f.host <=> d.host AND f.line = d.line"), "left_semi"))
    shares = hits.groupBy("host", "page").agg(F.sum("size").alias("frequent"), F.max(F.struct("size", "line")).alias("longest"))
    sizes = found.groupBy("host", "page").agg(F.sum("size").alias("size"))
    pooled = shares.alias("a").join(sizes.alias("b"), F.expr("a.host <=> b.host AND a.page = b.page AND 2 * a.frequent > b.size"))
    pooled = stored(pooled.select("a.host", "a.page", F.col("a.longest.line").alias("vote")))
    fewer = pooled.groupBy("host", "vote").agg(F.count(F.lit(1)).alias("n")).groupBy("host").agg(F.sum(F.col("n") - 1).alias("less"))
    votes = totals.alias("t").join(fewer.alias("p"), F.expr("t.host <=> p.host"), "left").select("t.host", (F.col("t.pages") - F.coalesce("p.less", F.lit(0))).alias("pages"))
    voted = hits.alias("f").join(pooled.alias("p"), F.expr("f.host <=> p.host AND f.page = p.page"), "left")
    own = voted.where("p.page IS NULL").groupBy("f.host", "f.line").agg(F.count(F.lit(1)).alias("n"))
    shared = voted.where("p.page IS NOT NULL").select("f.host", "f.line", "vote").distinct().groupBy("host", "line").agg(F.count(F.lit(1)).alias("n"))
    return hits, frequent(own.union(shared).groupBy("host", "line").agg(F.sum("n").alias("with_line")), votes, ratio, min_pages)


def cleaned(docs: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """The documents with their text cleaned; numbers of lines and dropped lines under reserved names."""
    hits, drops = boilerplate(docs, ratio, min_pages)
    hits = hits.alias("f").join(drops.alias("d"), F.expr("f.host <=> d.host AND f.line = d.line"), "left_semi")
    gone = stored(hits.groupBy("host", "page").agg(F.collect_set("line").alias("gone")))
    keyed = docs.withColumn("__line_dedup_page", text_key(F.col("text")))
    with_gone = keyed.alias("a").join(gone.hint("merge").alias("g"), F.expr("a.source <=> g.host AND a.__line_dedup_page = g.page"), "left")
    lines = F.split(F.col("a.text"), "\n")
    keep = F.filter(lines, lambda line: ~F.array_contains(F.col("g.gone"), text_key(bare(line))))
    kept = F.when(F.col("g.gone").isNull(), lines).otherwise(keep)
    mostly = 2 * F.char_length(F.array_join(kept, "\n")) >= F.char_length("a.text")
    rest = with_gone.select(*(F.col(f"a.`{c}`") for c in docs.columns), F.when(mostly, kept).otherwise(lines).alias("__line_dedup_kept"), F.size(lines).alias("__line_dedup_all"))
    text = [F.array_join("__line_dedup_kept", "\n").alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns]
    known, every = F.col("text").isNotNull(), F.col("__line_dedup_all")
    dropped = every - F.size("__line_dedup_kept")
    return rest.select(*text, F.when(known, every).otherwise(0).alias(N_LINES), F.when(known, dropped).otherwise(0).alias(N_DROPPED))


def without_boilerplate(docs: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """The documents with their text cleaned, and n_lines and n_dropped added."""
    out = cleaned(docs, ratio, min_pages).drop("n_lines", "n_dropped")
    return out.withColumnsRenamed({N_LINES: "n_lines", N_DROPPED: "n_dropped"})


#: The same in SQL over the table ``documents``; {ratio} and {min_pages} as above.
SQL = r"""
WITH pages AS (SELECT DISTINCT source, text FROM documents WHERE text IS NOT NULL),
lines AS (
  SELECT DISTINCT source, text, line FROM (
    SELECT source, text, trim(unnest(string_split(text, chr(10))), ' ' || chr(9) || chr(13) || chr(12) || chr(11)) AS line FROM pages) WHERE line <> ''),
totals AS (SELECT source, count(*) AS pages FROM pages GROUP BY source),
candidates AS (
  SELECT l.source, l.line FROM lines l JOIN totals t ON l.source IS NOT DISTINCT FROM t.source
  GROUP BY l.source, l.line, t.pages HAVING count(*) >= {min_pages} AND count(*) > {ratio} * t.pages),
hits AS (SELECT l.* FROM lines l JOIN candidates c ON l.source IS NOT DISTINCT FROM c.source AND l.line = c.line),
votes AS (
  SELECT p.source, p.text, CASE WHEN 2 * h.size > s.size THEN 'line ' || h.longest ELSE 'page ' || p.text END AS vote
  FROM pages p LEFT JOIN (SELECT source, text, sum(length(line)) AS size FROM lines GROUP BY source, text) s ON p.source IS NOT DISTINCT FROM s.source AND p.text = s.text
  LEFT JOIN (SELECT source, text, sum(length(line)) AS size, arg_max(line, {{'n': length(line), 'md5': md5(line)}}) AS longest FROM hits GROUP BY source, text) h
    ON p.source IS NOT DISTINCT FROM h.source AND p.text = h.text),
voters AS (SELECT source, count(DISTINCT vote) AS votes FROM votes GROUP BY source),
drops AS (
  SELECT h.source, h.line FROM hits h JOIN votes v ON h.source IS NOT DISTINCT FROM v.source AND h.text = v.text JOIN voters n ON h.source IS NOT DISTINCT FROM n.source
  GROUP BY h.source, h.line, n.votes HAVING count(DISTINCT v.vote) >= {min_pages} AND count(DISTINCT v.vote) > {ratio} * n.votes),
parts AS (
  SELECT d.doc_id, d.source, string_split(d.text, chr(10)) AS ls FROM documents d),
dropped AS (SELECT source, list(line) AS gone FROM drops GROUP BY source),
cut AS (
  SELECT p.doc_id, p.ls, list_filter(p.ls, lambda x: NOT list_contains(coalesce(g.gone, []), trim(x, ' ' || chr(9) || chr(13) || chr(12) || chr(11)))) AS kept
  FROM parts p LEFT JOIN dropped g ON p.source IS NOT DISTINCT FROM g.source),
halved AS (SELECT doc_id, ls, CASE WHEN 2 * length(array_to_string(kept, chr(10))) >= length(array_to_string(ls, chr(10))) THEN kept ELSE ls END AS kept FROM cut)
SELECT doc_id, array_to_string(kept, chr(10)) AS text, coalesce(len(ls), 0)::INTEGER AS n_lines, coalesce(len(ls) - len(kept), 0)::INTEGER AS n_dropped FROM halved
"""
