"""Policy retrieval: segments and chunks, TF-IDF weights, cosine top-k by an equi-join on terms, context blocks.

Tokens are runs of two or more letters, digits or underscores, lower case; terms are tokens and pairs of neighbours.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ouvidor.functions import fixed
from ouvidor.functions.text import escape_html, strip
from ouvidor.plans.registry import query
from ouvidor.sources.tables import POLICY_PAGES, policy_pages, table

c = F.col
TOKEN = r"[\p{L}\p{N}_]{2,}"


def normalise(text: Column) -> Column:
    return strip(F.regexp_replace(F.replace(text, F.lit("\r"), F.lit("")), r"[ \t]+", " "))


def segments(pages: DataFrame) -> DataFrame:
    """(page, seg, section, text): a page cut before every numbered heading."""
    parts = F.filter(F.transform(F.split(normalise(F.coalesce("text", F.lit(""))), r"(?U)(?=(?:\d+\.)+\d*\s+)"), strip), lambda p: p != "")
    rows = pages.select("page", F.posexplode(parts).alias("seg", "text"))
    line = F.element_at(F.split("text", "  ", 2), 1)
    numbered = F.regexp_extract(line, "(?uUd)" + fixed.SECTION_NUMBERED, 1)
    section = F.when(numbered != "", strip(numbered)).when(line.rlike("(?uUd)" + fixed.SECTION_TITLE), F.substring(line, 1, fixed.SECTION_CHARS)).otherwise(F.concat(F.lit("Página "), c("page").cast("string")))
    return rows.withColumn("section", section)


def chunks(pages: DataFrame, size: int = fixed.CHUNK_CHARS, overlap: int = fixed.CHUNK_OVERLAP, document: str = fixed.DOCUMENT_ID) -> DataFrame:
    """Windows of ``size`` characters that overlap; numbers run through the page."""
    if size <= overlap:
        raise ValueError("size must exceed overlap")
    n = F.length("text")
    last = F.greatest(F.lit(0), F.ceil((n - size) / (size - overlap))).cast("int")
    cut = segments(pages).select("*", F.explode(F.sequence(F.lit(0), last)).alias("i"))
    cut = cut.withColumn("text", strip(F.substr("text", c("i") * (size - overlap) + 1, F.lit(size)))).where("text <> ''")
    part = F.row_number().over(Window.partitionBy("page").orderBy("seg", "i")) - 1
    named = cut.withColumn("part", part)
    pad = lambda x: F.when(F.length(x.cast("string")) < 2, F.lpad(x.cast("string"), 2, "0")).otherwise(x.cast("string"))
    return named.select(F.concat(F.lit(document + "-p"), pad(c("page")), F.lit("-c"), pad(c("part"))).alias("chunk_id"), F.lit(document).alias("document_id"), "page", "section", "text", "part")


_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_NUMBERED_SQL = fixed.SECTION_NUMBERED.replace("(?=", "(?:")  # at the end of a pattern, taking in and looking ahead find the same
_SEGMENTS = rf"""WITH {POLICY_PAGES}, norm AS (SELECT page, {_STRIP.format("regexp_replace(replace(text, chr(13), ''), '[ \t]+', ' ', 'g')")} AS t FROM policy_pages),
parts AS (SELECT page, list_filter(list_transform(string_split(regexp_replace(t, '((?:\d+\.)+\d*\s+)', chr(1) || '\1', 'g'), chr(1)), lambda x: {_STRIP.format("x")}), lambda x: x <> '') AS p FROM norm),
raw AS (SELECT page, CAST(unnest(range(0, len(p))) AS INTEGER) AS seg, unnest(p) AS text FROM parts),
segs AS (SELECT page, seg, text, CASE WHEN regexp_extract(text, '{_NUMBERED_SQL}', 1) <> '' THEN {_STRIP.format(f"regexp_extract(text, '{_NUMBERED_SQL}', 1)")}
  WHEN regexp_matches(text, '{fixed.SECTION_TITLE}') THEN substr(text, 1, {fixed.SECTION_CHARS}) ELSE 'Página ' || page END AS section FROM raw)"""


@query("Q_segments", f"{_SEGMENTS} SELECT page, seg, section, text FROM segs")
def segment_rows(spark, sf_dir):
    return segments(policy_pages(spark, sf_dir)).select("page", "seg", "section", "text")


@query("Q_chunks", rf"""{_SEGMENTS}, cut AS (
  SELECT page, seg, i, section, {_STRIP.format("substr(text, CAST(i * 350 + 1 AS BIGINT), 400)")} AS text FROM (SELECT *, unnest(range(0, CAST(greatest(0, ceil((length(text) - 400) / 350.0)) AS BIGINT) + 1)) AS i FROM segs)),
num AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY seg, i) - 1 AS part FROM cut WHERE text <> '')
SELECT '{fixed.DOCUMENT_ID}-p' || CASE WHEN page < 10 THEN '0' ELSE '' END || page || '-c' || CASE WHEN part < 10 THEN '0' ELSE '' END || part AS chunk_id, page, section, text FROM num""")
def chunk_rows(spark, sf_dir):
    return chunks(policy_pages(spark, sf_dir), 400, 50).select("chunk_id", "page", "section", "text")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({TOKEN})"))


def terms(text: Column, pairs: bool = True) -> Column:
    t = tokens(text)
    if not pairs:
        return t
    return F.concat(t, F.zip_with(F.slice(t, 1, F.greatest(F.size(t) - 1, F.lit(0))), F.slice(t, 2, F.greatest(F.size(t) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b)))


def frequencies(docs: DataFrame, key: str, pairs: bool = True) -> DataFrame:
    return docs.select(key, F.explode(terms(c("text"), pairs)).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def idf(tf: DataFrame, n: int) -> DataFrame:
    return tf.groupBy("term").agg(F.count("*").alias("df")).withColumn("idf", F.log(F.lit(1.0 + n) / (1 + c("df"))) + 1)


def unit(weighted: DataFrame, key: str) -> DataFrame:
    """(key, term, w) scaled to length 1 for each key."""
    norms = weighted.groupBy(key).agg(F.sqrt(F.sum(c("w") * c("w"))).alias("norm"))
    return weighted.join(norms, key).select(key, "term", (c("w") / c("norm")).alias("w"))


#: Weights of an index that is broadcast; a larger one is joined by a shuffle on the term.
MOST_BROADCAST = 1_000_000


def index(docs: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(weights by key and term, idf by term)."""
    tf = frequencies(docs, key)
    i = idf(tf, docs.count())
    return unit(tf.join(i, "term").select(key, "term", ((1 + F.log("tf")) * c("idf")).alias("w")), key), i


_indexes: dict[tuple[str, str], tuple[DataFrame, DataFrame]] = {}


def cached_index(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """index() of the policy, built once for each application and folder; the weights are marked for broadcast if they are few."""
    name = (spark.sparkContext.applicationId, sf_dir)
    if name not in _indexes:
        weights, terms_idf = (x.persist() for x in index(policy(spark, sf_dir), "item_id"))
        few = weights.count() <= MOST_BROADCAST  # there are no more terms than weights
        _indexes[name] = (F.broadcast(weights), F.broadcast(terms_idf)) if few else (weights, terms_idf)
    return _indexes[name]


def forget_indexes() -> None:
    """Drop the cached indexes, as after a change of the policy."""
    for pair in _indexes.values():
        for x in pair:
            x.unpersist()
    _indexes.clear()


def query_text(text: Column, channel: Column, classification: Column) -> Column:
    """What the policy is asked for a complaint: text, channel and classification as it prints, without the empty ones."""
    said = F.concat(F.lit("{"), F.concat_ws(", ", *[F.concat(F.lit(f"'{k}': '"), classification[k], F.lit("'")) for k in fixed.OFFLINE]), F.lit("}"))
    return F.concat_ws(" ", F.when(text != "", text), F.when(channel != "", channel), F.when(classification.isNotNull(), said))


#: Terms times chunks of an index that every task holds as a matrix (64 MB).
LOCAL_CELLS = 8_000_000


def local_index(weights: DataFrame, terms_idf: DataFrame) -> tuple | None:
    """(words, terms as pairs of their numbers, idf, places and values of the matrix, chunks) of a small index; None of a larger one."""
    of = weights.select("item_id", "term", "w").limit(MOST_BROADCAST + 1).toArrow()
    named = terms_idf.select("term", "idf").limit(MOST_BROADCAST + 1).toArrow()
    items = np.unique(of.column("item_id").to_numpy())
    if not len(items) or max(of.num_rows, named.num_rows) > MOST_BROADCAST or len(items) * named.num_rows > LOCAL_CELLS:
        return None
    parts = [t.split(" ") for t in named.column("term").to_pylist()]
    words = sorted({w for p in parts for w in p})
    number = {w: i + 1 for i, w in enumerate(words)}
    codes = np.array([number[p[0]] * (len(words) + 1) + (number[p[1]] if len(p) > 1 else 0) for p in parts])
    order = np.argsort(codes)
    row = {t: i for i, t in enumerate(named.column("term").take(pa.array(order)).to_pylist())}
    at = np.array([row[t] for t in of.column("term").to_pylist()]) * len(items) + np.searchsorted(items, of.column("item_id").to_numpy())
    return words, codes[order], named.column("idf").to_numpy()[order], at, of.column("w").to_numpy(), items


def local_sources(near: tuple, prefix: str, k: int = fixed.TOP_K, least: float = fixed.RELEVANT, tile: int = 256):
    """A function of tokens to chunk ids, by the scores and ranks of retrieve(), of ``tile`` texts at once; null has none."""
    words, codes, idf, at, w, items = near

    def run(texts):
        known, ids = pa.array(words, type=pa.string()), [prefix + str(i) for i in items[::-1]]
        matrix = np.zeros(len(codes) * len(items))
        matrix[at] = w
        matrix = matrix.reshape(len(codes), len(items))
        out = []
        for low in range(0, len(texts), tile):
            part = texts.slice(low, tile)
            lengths = pc.fill_null(pc.list_value_length(part), 0).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(part)), lengths)
            one = pc.fill_null(pc.cast(pc.index_in(part.flatten(), value_set=known), pa.int64()), -1).to_numpy(zero_copy_only=False) + 1
            both = (one[:-1] > 0) & (one[1:] > 0) & (row[:-1] == row[1:])
            code = np.concatenate([one[one > 0] * (len(words) + 1), one[:-1][both] * (len(words) + 1) + one[1:][both]])
            row = np.concatenate([row[one > 0], row[:-1][both]])
            place = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
            hit = codes[place] == code
            used, term = np.unique(place[hit], return_inverse=True)
            tf = np.bincount(row[hit] * len(used) + term, minlength=len(part) * len(used)).reshape(len(part), len(used))
            q = np.where(tf > 0, 1 + np.log(np.maximum(tf, 1)), 0) * idf[used]
            q /= np.maximum(np.sqrt((q * q).sum(axis=1)), 1e-300)[:, None]
            score = np.round(q @ matrix[used], 6)[:, ::-1]
            best = np.argsort(-score, axis=1, kind="stable")[:, :k]
            out += [[ids[j] for j in js if score[i, j] >= least] for i, js in enumerate(best)]
        return pa.array(out, type=pa.list_(pa.string()))

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, returnType="array<string>")


def with_sources(rows: DataFrame, weights: DataFrame, terms_idf: DataFrame, prefix: str = "POL-") -> DataFrame:
    """+ fontes: chunk ids of the policy for every row that has a classification, best first; others have none.

    A row that brings ``fontes`` (found when its batch was made) keeps them, and nothing is looked up for it. An index of up to
    LOCAL_CELLS terms times chunks goes to the rows, which then are read once and not shuffled; a larger one meets them by term.
    """
    given = "fontes" in rows.columns
    wanted = c("classificacao").isNotNull() & c("texto").isNotNull()
    near = local_index(weights, terms_idf)
    if near is not None:
        none = F.array().cast("array<string>")
        asked_ = wanted & c("fontes").isNull() if given else wanted
        found_ = local_sources(near, prefix)(F.when(asked_, tokens(query_text(c("texto"), c("canal"), c("classificacao")))))
        return rows.withColumn("fontes", F.coalesce("fontes", found_, none) if given else found_)
    asked = rows.where(wanted & c("fontes").isNull() if given else wanted)
    asked = asked.select("row_idx", query_text(c("texto"), c("canal"), c("classificacao")).alias("text"))
    found = retrieve(asked, "row_idx", weights, terms_idf, "item_id", "item_id")
    best = F.transform(F.array_sort(F.collect_list(F.struct("rank", "item_id"))), lambda x: F.concat(F.lit(prefix), x["item_id"].cast("string")))  # at most k
    by_row = found.groupBy("row_idx").agg(best.alias("__found"))
    none = F.array().cast("array<string>")
    fontes = F.coalesce("fontes", "__found", none) if given else F.coalesce("__found", none)
    return rows.join(by_row, "row_idx", "left").withColumn("fontes", fontes).drop("__found")


def retrieve(queries: DataFrame, key: str, weights: DataFrame, terms_idf: DataFrame, chunk_key: str, order: str, k: int = fixed.TOP_K, least: float = fixed.RELEVANT) -> DataFrame:
    """The best ``k`` chunks of each query, then those of at least ``least``; of equal scores the later chunk first.
    Sparse vectors meet by term: what shares no term is never paired."""
    q = unit(frequencies(queries, key).join(terms_idf, "term").select(key, "term", ((1 + F.log("tf")) * c("idf")).alias("w")), key)
    scored = q.join(weights.withColumnRenamed("w", "wc"), "term").groupBy(key, chunk_key).agg(F.round(F.sum(c("w") * c("wc")), 6).alias("score"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), F.desc(order)))
    return scored.withColumn("rank", rank).where((c("rank") <= k) & (c("score") >= least))


_TFIDF = r"""w AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]{2,}') AS t FROM benchmark),
tm AS (SELECT item_id, unnest(list_concat(t, CASE WHEN len(t) > 1 THEN list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]) ELSE [] END)) AS term FROM w),
tf AS (SELECT item_id, term, count(*) AS tf FROM tm GROUP BY ALL),
idf AS (SELECT term, count(*) AS df, ln((1.0 + (SELECT count(*) FROM benchmark)) / (1 + count(*))) + 1 AS idf FROM tf GROUP BY term),
raw AS (SELECT item_id, term, (1 + ln(tf)) * idf AS w FROM tf JOIN idf USING (term)),
weights AS (SELECT item_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY item_id)) AS w FROM raw)"""


def policy(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", "text")


@query("Q_tfidf_weights", f"WITH {_TFIDF} SELECT item_id, term, round(w, 9) AS w FROM weights")
def tfidf_weights(spark, sf_dir):
    return index(policy(spark, sf_dir), "item_id")[0].withColumn("w", F.round("w", 9))


TFIDF = _TFIDF
RANKED = r"""qt AS (SELECT q, unnest(list_concat(t, CASE WHEN len(t) > 1 THEN list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]) ELSE [] END)) AS term FROM qw),
qf AS (SELECT q, term, count(*) AS tf FROM qt GROUP BY ALL), qr AS (SELECT q, term, (1 + ln(tf)) * idf AS w FROM qf JOIN idf USING (term)),
qn AS (SELECT q, term, w / sqrt(sum(w * w) OVER (PARTITION BY q)) AS w FROM qr),
s AS (SELECT q, item_id, round(sum(qn.w * weights.w), 6) AS score FROM qn JOIN weights USING (term) GROUP BY q, item_id),
topk AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, item_id DESC) AS rank FROM s)"""
_TOPK = f"""{_TFIDF}, qw AS (SELECT conv_id * 1000 + turn AS q, regexp_extract_all(lower(coalesce(text, '')), '{TOKEN}') AS t FROM conversations WHERE role = 'user'),
{RANKED}"""


def user_turns(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "conversations").where(c("role") == "user").select((c("conv_id") * 1000 + c("turn")).alias("q"), "text")


def top_chunks(spark, sf_dir) -> DataFrame:
    weights, i = cached_index(spark, sf_dir)
    return retrieve(user_turns(spark, sf_dir), "q", weights, i, "item_id", "item_id")


@query("Q_retrieve_topk", f"WITH {_TOPK} SELECT q, item_id, score FROM topk WHERE rank <= {fixed.TOP_K} AND score >= {fixed.RELEVANT}")
def retrieve_topk(spark, sf_dir):
    return top_chunks(spark, sf_dir).select("q", "item_id", "score")


def context(sources: Column) -> Column:
    """Delimited blocks of an array of (chunk_id, page, section, text), or the mark that there is none."""
    def block(s):
        e = lambda f: escape_html(s[f].cast("string"))
        return F.concat(F.lit('<fonte chunk_id="'), e("chunk_id"), F.lit('" pagina="'), e("page"), F.lit('" secao="'), e("section"), F.lit('">\n'), e("text"), F.lit("\n</fonte>"))

    return F.when(F.size(sources) > 0, F.array_join(F.transform(sources, block), "\n\n")).otherwise(fixed.NO_CONTEXT)


_ESC = "replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"


@query("Q_context_format", f"""WITH {_TOPK}, kept AS (SELECT * FROM topk WHERE rank <= {fixed.TOP_K} AND score >= {fixed.RELEVANT}),
blocks AS (SELECT q, rank, '<fonte chunk_id="POL-' || item_id || '" pagina="' || item_id || '" secao="2.1">' || chr(10) || {_ESC} || chr(10) || '</fonte>' AS b FROM kept JOIN benchmark USING (item_id)),
j AS (SELECT q, string_agg(b, chr(10) || chr(10) ORDER BY rank) AS b FROM blocks GROUP BY q)
SELECT qw.q, coalesce(b, '{fixed.NO_CONTEXT}') AS contexto FROM qw LEFT JOIN j ON qw.q = j.q""")
def context_format(spark, sf_dir):
    found = top_chunks(spark, sf_dir).join(policy(spark, sf_dir), "item_id")
    source = F.struct("rank", F.concat(F.lit("POL-"), c("item_id").cast("string")).alias("chunk_id"), c("item_id").alias("page"), F.lit("2.1").alias("section"), "text")
    by_query = found.groupBy("q").agg(F.array_sort(F.collect_list(source)).alias("fontes"))  # at most k
    rows = user_turns(spark, sf_dir).select("q").join(by_query, "q", "left")
    return rows.select("q", context(F.coalesce("fontes", F.array().cast(by_query.schema["fontes"].dataType))).alias("contexto"))


@query("Q_tfidf_top_terms", r"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]{2,}')) AS term FROM documents),
n AS (SELECT term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM w WHERE term NOT IN (""" + ", ".join(f"'{s}'" for s in fixed.STOP_WORDS) + r""") GROUP BY term)
SELECT term, tf, round(ln((1.0 + (SELECT count(*) FROM documents)) / (1 + df)) + 1, 9) AS idf FROM n ORDER BY tf DESC, term LIMIT 300""")
def tfidf_top_terms(spark, sf_dir):
    """The 300 most frequent terms of the corpus (the vocabulary's size is the feature) with their idf."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    tf = frequencies(docs, "doc_id", pairs=False).where(~c("term").isin(fixed.STOP_WORDS))
    top = tf.groupBy("term").agg(F.sum("tf").alias("tf"), F.count("*").alias("df")).orderBy(F.desc("tf"), "term").limit(300)
    return top.select("term", "tf", F.round(F.log(F.lit(1.0 + docs.count()) / (1 + c("df"))) + 1, 9).alias("idf"))
