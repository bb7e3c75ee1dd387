"""One production query per operator, over whole tables, and their SQL twins.

The operators keep general interfaces; a query reads its table, runs the
operator with production parameters and derives the digest columns.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the given folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def piece_model() -> str:
    """Default path of the public merge-type vocabulary; a parameter of the operator."""
    try:
        import public_tokenizers

        return public_tokenizers.path("piece_bpe_32k.model")
    except ImportError:
        return os.path.join("/opt/tokenizers", "piece_bpe_32k.model")


def held_out(key: Column) -> Column:
    """True for the rows no model may learn from."""
    return F.crc32(key.cast("string")) % 5 == 0


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sentencepieces import encoding_digests

    return encoding_digests(table(spark, sf_dir, "documents"), piece_model())


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where("toxic IN (0, 1)").where(~held_out(F.col("doc_id")))
    model = toxicity.train(docs, labels.select("doc_id", "toxic"))
    out = toxicity.score(docs, model)
    spans = F.to_json("spans").alias("spans")
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted", spans)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import langid

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train(docs.where(~held_out(F.col("doc_id"))))
    out = langid.predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .forest import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .linededup import dedup_lines

    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", "text")


def op3_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import describe_documents

    return describe_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def file_path() -> Column:
    """Path of a document in a tree of sources, languages and folders; some files lie in the upper directories."""
    depth = F.when(F.col("doc_id") % 50 == 0, 1).when(F.col("doc_id") % 50 == 1, 2).when(F.col("doc_id") % 5 == 2, 3).otherwise(4)
    parts = F.array(F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), F.expr("doc_id DIV 1000").cast("string"), F.expr("doc_id DIV 10").cast("string"))
    return F.concat(F.array_join(F.slice(parts, F.lit(1), depth), "/"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan

    return scan(table(spark, sf_dir, "documents").select("doc_id", file_path().alias("path"), "text"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngramjoin import jaccard_join

    return jaccard_join(table(spark, sf_dir, "documents").select("doc_id", "text"))


# target weights of the mixture; parameters of the query
DOMAINS = {"web": ([f"src{i}" for i in range(10)], 50), "books": ([f"src{i}" for i in range(10, 15)], 25), "code": ([f"src{i}" for i in range(15, 20)], 20)}
OTHER_DOMAIN = ("other", 5)
LANGUAGES = {"en": 60, "de": 15, "fr": 15, "es": 10}
OTHER_LANGUAGE = 5
MAX_EPOCHS = 2


def domain_of() -> Column:
    out = F.lit(OTHER_DOMAIN[0])
    for name, (sources, _) in DOMAINS.items():
        out = F.when(F.col("source").isin(sources), name).otherwise(out)
    return out


def mixture_weights() -> dict[str, Column]:
    domain, lang = F.lit(OTHER_DOMAIN[1]), F.lit(OTHER_LANGUAGE)
    for name, (_, w) in DOMAINS.items():
        domain = F.when(F.col("domain") == name, w).otherwise(domain)
    for name, w in LANGUAGES.items():
        lang = F.when(F.col("lang") == name, w).otherwise(lang)
    return {"domain": domain, "lang": lang, "source": F.lit(1)}


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix, word_count
    from .store import materialise

    docs = table(spark, sf_dir, "documents")
    slim = docs.select("doc_id", domain_of().alias("domain"), "lang", "source", word_count(F.col("text")).alias("n_tokens"))
    return mix(materialise(slim, "tokens"), ["domain", "lang", "source"], mixture_weights(), max_epochs=MAX_EPOCHS)


def mixing_sql() -> str:
    """DuckDB twin of op9: the same closed form of the budgets and the same order."""
    when = " ".join(f"WHEN source IN ({', '.join(repr(x) for x in src)}) THEN '{n}'" for n, (src, _) in DOMAINS.items())
    wd = " ".join(f"WHEN l0 = '{n}' THEN {w}" for n, (_, w) in DOMAINS.items())
    wl = " ".join(f"WHEN l1 = '{n}' THEN {w}" for n, w in LANGUAGES.items())
    ctes = [
        f"""d AS (SELECT doc_id, CASE {when} ELSE '{OTHER_DOMAIN[0]}' END AS domain, lang, source,
            CAST(len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\r\\n\\f]+')) AS BIGINT) AS n_tokens FROM documents)""",
        "b AS (SELECT *, domain AS l0, coalesce(lang, '') AS l1, coalesce(source, '') AS l2 FROM d)",
        f"""c0 AS (SELECT *, CASE {wd} ELSE {OTHER_DOMAIN[1]} END AS w0, CASE {wl} ELSE {OTHER_LANGUAGE} END AS w1, 1 AS w2,
            tokens * {MAX_EPOCHS} AS cap, CAST(sum(tokens) OVER () AS HUGEINT) AS b0
            FROM (SELECT l0, l1, l2, CAST(sum(n_tokens) AS HUGEINT) AS tokens FROM b GROUP BY ALL))""",
    ]
    for i in range(3):
        path = ", ".join(f"l{k}" for k in range(i + 1))
        up = "PARTITION BY " + ", ".join(f"l{k}" for k in range(i)) if i else ""
        order = f"ORDER BY CAST(c AS DOUBLE) / CAST(w AS DOUBLE), {path}"
        ctes += [
            f"n{i} AS (SELECT {path}, CAST(sum(cap) AS HUGEINT) AS c, first(w{i}) AS w, first(b{i}) AS b FROM c{i} GROUP BY {path})",
            f"""m{i} AS (SELECT *, b - coalesce(sum(c) OVER ({up} {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remain,
                sum(w) OVER ({up} {order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws FROM n{i})""",
            f"f{i} AS (SELECT *, min(CASE WHEN c * ws <= greatest(remain, 0) * w THEN 1 ELSE 0 END) OVER ({up} {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS whole FROM m{i})",
            f"""g{i} AS (SELECT *, sum(CASE WHEN whole = 1 THEN c ELSE 0 END) OVER ({up}) AS used,
                sum(CASE WHEN whole = 0 THEN w ELSE 0 END) OVER ({up}) AS open FROM f{i})""",
            f"""c{i + 1} AS (SELECT c{i}.*, CASE WHEN whole = 1 THEN c ELSE CAST(greatest(b - used, 0) AS HUGEINT) * w // open END AS b{i + 1}
                FROM c{i} JOIN g{i} USING ({path}))""",
        ]
    ctes += [
        """p AS (SELECT l0, l1, l2, CASE WHEN tokens > 0 THEN b3 // tokens ELSE 0 END AS whole,
            CASE WHEN tokens > 0 THEN b3 % tokens ELSE 0 END AS rest FROM c3)""",
        "h AS (SELECT b.*, whole, rest, md5('9:' || CAST(CAST(whole AS BIGINT) AS VARCHAR) || ':' || coalesce(CAST(doc_id AS VARCHAR), '')) AS o FROM b JOIN p USING (l0, l1, l2))",
        "r AS (SELECT *, sum(n_tokens) OVER (PARTITION BY l0, l1, l2 ORDER BY o RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM h)",
    ]
    return f"WITH {', '.join(ctes)} SELECT doc_id, domain, lang, source, n_tokens, CAST(whole + CASE WHEN rest > 0 AND run <= rest THEN 1 ELSE 0 END AS INTEGER) AS copies FROM r"


def license_sql(threshold: float = 0.6) -> str:
    """DuckDB twin of op6: every window of the notices (where it has names, from the first of them), and all ancestors of every folder."""
    from .licenses import LANDMARKS, NAMES, SPREAD, VAGUE, templates

    quoted = lambda words: ", ".join(f"'{w}'" for w in sorted(words))
    rows = ", ".join(f"({i}, '{name}', {name in VAGUE or text in VAGUE}, {full}, '{' '.join(words)}')" for i, (name, text, full, words) in enumerate(templates()))
    tokens = "regexp_extract_all(lower(text), '[a-z0-9.]*[a-z0-9]')"
    return f"""
    WITH r AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, text, lang, source FROM documents),
    t AS (SELECT template, license, vague, whole, string_split(x, ' ') AS ws FROM (VALUES {rows}) v(template, license, vague, whole, x)),
    tw AS (SELECT template, vague, whole, len(ws) AS size, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS off FROM t),
    ttf AS (SELECT template, whole, size, word, count(*) AS tf, NOT whole AND word IN ({quoted(NAMES)}) AS need FROM tw GROUP BY ALL),
    files AS MATERIALIZED (SELECT row, {tokens} AS ws FROM r WHERE text IS NOT NULL),
    n AS (SELECT count(*) AS n FROM files),
    df AS (SELECT word, count(*) AS df FROM (SELECT DISTINCT row, unnest(ws) AS word FROM files) WHERE word IN (SELECT word FROM ttf) GROUP BY word),
    idf AS (SELECT word, coalesce(df, 0) AS df, ln((1.0::DOUBLE + n) / (1.0::DOUBLE + coalesce(df, 0))) + 1 AS idf FROM (SELECT DISTINCT word FROM ttf) LEFT JOIN df USING (word), n),
    v AS (SELECT template, whole, size, word, need, tf, df, tf * idf AS weight, sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY template)) AS norm, count(*) FILTER (WHERE need) OVER (PARTITION BY template) AS needed FROM ttf JOIN idf USING (word)),
    a AS (SELECT template, min(word) AS word, size FROM v WHERE need GROUP BY template, size),
    l AS (SELECT v.template, v.word, tw.off, v.size FROM v JOIN tw USING (template, word) WHERE v.whole AND v.tf = 1
          QUALIFY row_number() OVER (PARTITION BY v.template, (({SPREAD} * (tw.off + 1) - 1) // v.size) ORDER BY df, v.word) = 1),
    p AS MATERIALIZED (SELECT row, len(ws) AS n, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS pos FROM files),
    w AS (SELECT DISTINCT row, template, unnest(range(greatest(pos - size + 1, 0), pos + 1)) AS spot, size FROM p JOIN a USING (word)
          UNION ALL SELECT row, template, pos AS spot, size FROM p, (SELECT DISTINCT template, size FROM v WHERE needed = 0 AND NOT whole)
          UNION ALL SELECT DISTINCT row, template, greatest(pos - off, 0) AS spot, size FROM p JOIN l USING (word)),
    held AS (SELECT template, list(word) AS held, bool_or(whole) AS whole FROM v GROUP BY template),
    marks AS (SELECT template, list(DISTINCT word) AS marks FROM l GROUP BY template),
    fit AS (SELECT w.* FROM w JOIN files USING (row) JOIN held USING (template) LEFT JOIN marks USING (template)
            WHERE CASE WHEN whole THEN len(list_intersect(marks, ws[spot + 1:spot + size])) >= least({LANDMARKS}, len(marks)) ELSE list_contains(held, ws[spot + 1]) END),
    x AS (SELECT row, template, spot, unnest(ws[spot + 1:spot + size]) AS word FROM fit JOIN files USING (row)),
    xtf AS (SELECT row, template, spot, word, count(*) AS tf FROM x GROUP BY ALL),
    xw AS (SELECT xtf.*, xtf.tf * coalesce(idf, ln(1.0::DOUBLE + n) + 1) AS u FROM xtf LEFT JOIN idf USING (word), n),
    s AS (SELECT xw.row, xw.template, xw.spot, round(sum(u * v.weight) / (sqrt(sum(u * u)) * max(k.norm)), 6) AS score, count(*) FILTER (WHERE v.need) AS held, max(k.needed) AS needed
          FROM xw LEFT JOIN v ON v.template = xw.template AND v.word = xw.word JOIN (SELECT DISTINCT template, norm, needed FROM v) k ON k.template = xw.template GROUP BY xw.row, xw.template, xw.spot),
    best AS (SELECT row, license, score FROM s JOIN t USING (template) WHERE score >= {threshold} AND held = needed QUALIFY row_number() OVER (PARTITION BY row ORDER BY vague, score DESC, license, spot) = 1),
    q AS (SELECT row, doc_id, [coalesce(source, 'none'), coalesce(lang, 'none'), CAST(doc_id // 1000 AS VARCHAR), CAST(doc_id // 10 AS VARCHAR)] AS parts,
          CASE WHEN doc_id % 50 = 0 THEN 1 WHEN doc_id % 50 = 1 THEN 2 WHEN doc_id % 5 = 2 THEN 3 ELSE 4 END AS depth FROM r),
    f AS (SELECT q.*, array_to_string(parts[1:depth], '/') AS dir, array_to_string(parts[1:depth], '/') || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS path, license AS own, score AS own_score FROM q LEFT JOIN best USING (row)),
    holder AS (SELECT dir AS up, own AS up_own, own_score AS up_score FROM f WHERE own IS NOT NULL QUALIFY row_number() OVER (PARTITION BY dir ORDER BY doc_id, path) = 1),
    chain AS (SELECT row, unnest(range(1, depth + 1)) AS k, parts FROM f),
    near AS (SELECT row, up, up_own, up_score FROM chain JOIN holder ON up = array_to_string(parts[1:k], '/') QUALIFY row_number() OVER (PARTITION BY row ORDER BY k DESC) = 1)
    SELECT doc_id, path, coalesce(own, up_own) AS license, coalesce(own_score, up_score) AS score, CASE WHEN own IS NOT NULL THEN path ELSE up END AS from_path FROM f LEFT JOIN near USING (row)
    """


def line_dedup_sql(min_chars: int = 20) -> str:
    """DuckDB twin of op2 by the definition: maximal runs of equal lines at one distance in a pair of documents."""
    return f"""
    WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line, unnest(string_split(text, chr(10))) AS raw FROM documents WHERE text IS NOT NULL),
    s AS MATERIALIZED (SELECT *, md5(trim(raw, ' ')) AS h, length(trim(raw, ' ')) AS chars FROM l),
    m AS (SELECT a.doc_id, a.line, a.chars, b.doc_id AS other, a.line - b.line AS off FROM s a JOIN s b ON a.h = b.h AND (b.doc_id < a.doc_id OR b.doc_id = a.doc_id AND b.line < a.line)),
    r AS (SELECT DISTINCT doc_id, min(line) AS start, max(line) AS stop FROM (SELECT *, line - row_number() OVER (PARTITION BY doc_id, other, off ORDER BY line) AS i FROM m)
          GROUP BY doc_id, other, off, i HAVING sum(chars) >= {min_chars}),
    g AS (SELECT DISTINCT doc_id, line, true AS gone FROM (SELECT doc_id, unnest(range(start, stop + 1)) AS line FROM r)),
    o AS (SELECT s.doc_id, count(*) AS n_lines, count(gone) AS n_removed, string_agg(raw, chr(10) ORDER BY s.line) FILTER (WHERE gone IS NULL) AS kept
          FROM s LEFT JOIN g ON g.doc_id = s.doc_id AND g.line = s.line GROUP BY s.doc_id)
    SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, CASE WHEN d.text IS NOT NULL THEN coalesce(kept, '') END AS text FROM documents d LEFT JOIN o USING (doc_id)
    """


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extract, fit_tree, training_table

    tree = fit_tree(training_table(spark))
    out = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"), tree)
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .divergence import divergence

    return divergence(table(spark, sf_dir, "documents").select("text", "lang", "source"))


def divergence_sql(least_docs: int = 30, top: int = 50) -> str:
    """DuckDB twin of op11 over all groups, terms and pairs."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    share = lambda c, n: f"1 + (CAST(1000000000 AS HUGEINT) * ({c} + 5)) // ({n} + 5 * v)"
    return f"""
    WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), '{upper}', '{upper.lower()}') AS text FROM documents),
    o AS (SELECT row, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
    k AS (SELECT lang, term, count(*) AS ql FROM o GROUP BY lang, term HAVING count(DISTINCT row) >= {least_docs}),
    c AS (SELECT lang, source, term, count(*) AS c FROM o JOIN k USING (lang, term) GROUP BY ALL),
    l AS (SELECT lang, count(*) AS v, CAST(sum(ql) AS BIGINT) AS nl FROM k GROUP BY lang),
    g AS (SELECT lang, source, CAST(coalesce(sum(c), 0) AS BIGINT) AS n FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY ALL),
    p AS (SELECT g.lang, g.source, k.term, coalesce(c, 0) AS c, {share("coalesce(c, 0)", "n")} AS p, {share("ql", "nl")} AS q
          FROM g JOIN k ON k.lang = g.lang JOIN l ON l.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
    f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS f FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
    x AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
          UNION ALL SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM p WHERE c > 0 AND p > q),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INTEGER) AS rank FROM x)
    SELECT * FROM r WHERE part = 'pair' OR rank <= {top}
    """


def op12_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffixes import dedup_bytes

    out = dedup_bytes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def suffix_dedup_sql(depth: int = 50) -> str:
    """DuckDB twin of op12 by its definition, on hexadecimal strings of two digits a byte."""
    return f"""
    WITH d AS (SELECT row_number() OVER () AS row, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
    w AS (SELECT row, doc_id, i, substr(h, 2 * i + 1, {2 * depth}) AS s FROM (SELECT *, unnest(range(0, len(h) // 2 - {depth - 1})) AS i FROM d)),
    low AS (SELECT s, min(doc_id) AS doc_id FROM w GROUP BY s),
    hit AS (SELECT w.row, w.i, true AS hit FROM w JOIN low ON low.s = w.s AND low.doc_id < w.doc_id),
    b AS (SELECT row, i, substr(h, 2 * i + 1, 2) AS x FROM (SELECT *, unnest(range(0, len(h) // 2)) AS i FROM d)),
    c AS (SELECT b.*, coalesce(max(CASE WHEN hit THEN b.i END) OVER (PARTITION BY b.row ORDER BY b.i) > b.i - {depth}, false) AS gone FROM b LEFT JOIN hit ON hit.row = b.row AND hit.i = b.i),
    e AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY row ORDER BY i), false) AS starts FROM c),
    o AS (SELECT row, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE starts) AS n_spans, coalesce(string_agg(x, '' ORDER BY i) FILTER (WHERE NOT gone), '') AS kept FROM e GROUP BY row)
    SELECT doc_id, len(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN o USING (row)
    """


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .whitening import whiten

    return whiten(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_embedding_near_dedup": op1_embedding_near_dedup,
        "op2_line_dedup": op2_line_dedup,
        "op3_media_chunks": op3_media_chunks,
        "op4_ngram_jaccard_join": op4_ngram_jaccard_join,
        "op5_sentencepiece": op5_sentencepiece,
        "op6_license_scan": op6_license_scan,
        "op7_toxicity": op7_toxicity,
        "op8_language_id": op8_language_id,
        "op9_source_mixing": op9_source_mixing,
        "op10_main_text": op10_main_text,
        "op11_source_divergence": op11_source_divergence,
        "op12_suffix_array_dedup": op12_suffix_array_dedup,
        "op13_embedding_whitening": op13_embedding_whitening,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_line_dedup": line_dedup_sql(),
        "op6_license_scan": license_sql(),
        "op9_source_mixing": mixing_sql(),
        "op11_source_divergence": divergence_sql(),
        "op12_suffix_array_dedup": suffix_dedup_sql(),
    }
