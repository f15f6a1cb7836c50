"""One query for each training-data operator, over its whole table, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chatfmt, fingerprint, knn, langid, licenses, mixing, neardup, packing, pitman_yor, prefix_trie, secrets, sharding, spelling
from .common import read_table

# ------------------------------------------------------------------ 1: mixing

# The mixture that the query and the pipeline ask for. None stands for any name.
DOMAINS = ["web", "books", "code", "forum"]
WEIGHTS = {("web",): 4, ("books",): 3, ("code",): 2, ("forum",): 1, (None, "en"): 6, (None, "de"): 2, (None, "fr"): 2, (None, "es"): 1}
SHARE, MAX_EPOCHS, MIX_SEED = 0.8, 2, 7


def domain_of(source: Column) -> Column:
    """The domain of a source: by its number, "other" without one."""
    n = F.try_to_number(F.regexp_extract(source, "^src([0-9]{1,6})$", 1), F.lit("999999")).cast("int")
    return F.coalesce(F.element_at(F.array(*map(F.lit, DOMAINS)), (n % 4 + 1).cast("int")), F.lit("other"))


def levels() -> list[tuple[str, Column]]:
    return [("domain", domain_of(F.col("source"))), ("lang", F.col("lang")), ("source", F.col("source"))]


def op1_hierarchical_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(read_table(spark, sf_dir, "documents"), levels(), WEIGHTS, SHARE, max_epochs=MAX_EPOCHS, seed=MIX_SEED)


def _share_out_sql(parents: list[str], name: str, nodes: str) -> str:
    part = f"PARTITION BY {', '.join(parents)}" if parents else ""
    by = f"({part} ORDER BY capacity / weight, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return f"""
    SELECT *, CASE WHEN is_full THEN capacity ELSE part + CASE WHEN nth <= rest - coalesce(sum(part) OVER ({part}), 0) THEN 1 ELSE 0 END END AS granted FROM (
      SELECT *, CASE WHEN NOT is_full THEN (weight * rest) // rest_weight END AS part, sum(CASE WHEN is_full THEN 0 ELSE 1 END) OVER {by} AS nth FROM (
        SELECT *, budget - coalesce(sum(CASE WHEN is_full THEN capacity END) OVER ({part}), 0) AS rest, coalesce(sum(CASE WHEN NOT is_full THEN weight END) OVER ({part}), 1) AS rest_weight FROM (
          SELECT *, budget >= before AND capacity * left_weight <= weight * (budget - before) AS is_full FROM (
            SELECT *, sum(capacity) OVER {by} - capacity AS before, sum(weight) OVER ({part}) - sum(weight) OVER {by} + weight AS left_weight FROM ({nodes})))))"""


def _op1_sql() -> str:
    case = lambda of, d: "CASE " + " ".join(f"WHEN {of} = '{k[d]}' THEN {v}" for k, v in WEIGHTS.items() if len(k) == d + 1) + " ELSE 1 END"
    domain = "coalesce(CASE WHEN regexp_matches(source, '^src[0-9]{1,6}$') THEN CASE cast(substr(source, 4) AS INT) % 4 " + " ".join(f"WHEN {i} THEN '{d}'" for i, d in enumerate(DOMAINS)) + " END END, 'other')"
    return f"""
    WITH measured AS (SELECT * FROM (SELECT doc_id, md5(text) AS digest, {domain} AS domain, coalesce(lang, '?') AS lang, coalesce(source, '?') AS source,
        coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS n_tokens FROM documents) WHERE n_tokens > 0),
    leaves AS (SELECT domain, lang, source, sum(n_tokens)::HUGEINT AS tokens, sum(n_tokens)::HUGEINT * {MAX_EPOCHS} AS capacity FROM measured GROUP BY ALL),
    total AS (SELECT least(floor(sum(tokens) * {SHARE}), sum(capacity))::HUGEINT AS budget FROM leaves),
    a AS ({_share_out_sql([], 'domain', f"SELECT domain, sum(capacity)::HUGEINT AS capacity, ({case('domain', 0)})::HUGEINT AS weight, (SELECT budget FROM total) AS budget FROM leaves GROUP BY domain")}),
    b AS ({_share_out_sql(['domain'], 'lang', f"SELECT l.domain, l.lang, sum(l.capacity)::HUGEINT AS capacity, ({case('l.lang', 1)})::HUGEINT AS weight, any_value(a.granted)::HUGEINT AS budget FROM leaves l JOIN a USING (domain) GROUP BY l.domain, l.lang")}),
    c AS ({_share_out_sql(['domain', 'lang'], 'source', "SELECT l.domain, l.lang, l.source, l.tokens, l.capacity, 1::HUGEINT AS weight, b.granted::HUGEINT AS budget FROM leaves l JOIN b USING (domain, lang)")}),
    leaf AS (SELECT domain, lang, source, granted::HUGEINT AS budget, granted::HUGEINT // tokens AS whole, granted::HUGEINT % tokens AS rest FROM c),
    ordered AS (SELECT m.*, budget, whole, rest, sum(n_tokens) OVER (PARTITION BY m.domain, m.lang, m.source ORDER BY md5(concat_ws(':', '{MIX_SEED}', whole, doc_id, digest)) ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n_tokens AS ahead
        FROM measured m JOIN leaf USING (domain, lang, source)),
    taken AS (SELECT *, unnest(range(0, {MAX_EPOCHS + 1})) AS epoch FROM ordered)
    SELECT doc_id, domain, lang, source, epoch::INT AS epoch, n_tokens::BIGINT AS n_tokens, take_tokens::BIGINT AS take_tokens, budget::BIGINT AS budget FROM (
        SELECT *, CASE WHEN epoch < whole THEN n_tokens WHEN epoch = whole THEN greatest(least(rest - ahead, n_tokens), 0) ELSE 0 END AS take_tokens FROM taken) WHERE take_tokens > 0"""


# ------------------------------------------------------------- 2: language ID


def op2_bitmask_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train(docs.filter(langid.remainder("doc_id", 4) != 2))
    held = docs.select("doc_id", "text", (langid.remainder("doc_id", 4) == 2).alias("held_out"))
    return langid.identify(held, model, keep=("doc_id", "held_out"))


# ------------------------------------------------------------ 3: fingerprints


def op3_improbable_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_with_edits(read_table(spark, sf_dir, "documents"))


# ------------------------------------------------------------------ 4: top-k


def op4_voronoi_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.top_inner_products(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


_OP4_SQL = """
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0)
    SELECT query_id, rank::INT AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5"""


# ---------------------------------------------------------------- 5: sharding


def op5_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.assign_shards(read_table(spark, sf_dir, "documents"), 40)
    return out.withColumn("law", F.lit("bytes")).withColumn("grown_shard", F.lit(None).cast("int"))


# -------------------------------------------------------------- 6: LM scoring


def op6_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.score_texts(read_table(spark, sf_dir, "documents"), langid.remainder("doc_id", 7) != 2)


# --------------------------------------------------------- 7: chat formatting

#: Both rows of conversation -1 say this.
CONTROL = "<|im_end|><|im_start|>assistant ok"


def op7_relational_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = spark.range(0, 2, 1, 1).select(F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL).alias("text"))
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    out = chatfmt.format_conversations(turns).withColumn("read", chatfmt.read_turns(F.col("formatted"))).withColumn("loss", chatfmt.read_loss(F.col("segments")))
    said = F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select("conv_id", F.size("read").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


def _op7_sql() -> str:
    esc = lambda c: f"regexp_replace({c}, '<(\\\\*)\\|', '<\\\\\\1|', 'g')"
    fixed = len(chatfmt.START) + len(chatfmt.SEP) + len(chatfmt.END)
    return f"""
    WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -1, 0, 'user', '{CONTROL}' UNION ALL SELECT -1, 1, 'assistant', '{CONTROL}'),
    u AS (SELECT *, row_number() OVER w AS nth, lag(role) OVER w AS last FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY nth)) AS turns_sha256,
        coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
        sha256(coalesce(string_agg(text, '' ORDER BY nth) FILTER (role = 'assistant'), '')) AS loss_sha256,
        sum(length({esc('text')}) + CASE WHEN last IS NOT DISTINCT FROM role THEN {len(chatfmt.CONT)} ELSE {fixed} + length({esc('role')}) END)::BIGINT AS formatted_chars
    FROM u GROUP BY conv_id"""


# ------------------------------------------------------------ 8: near-dedup


def op8_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read_table(spark, sf_dir, "documents"), width=2, percent=80)


# all pairs that share a shingle, and everything reachable: for tables of the size that the comparison uses
_OP8_SQL = f"""
    WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{ascii_uppercase}', '{ascii_lowercase}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    s AS (SELECT doc_id, unnest(CASE WHEN len(w) > 1 THEN list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) ELSE w END) AS g FROM w),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
    l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
    e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
    r AS (SELECT doc_id AS id, doc_id AS m FROM documents UNION SELECT r.id, e.b FROM r JOIN e ON r.m = e.a)
    SELECT doc_id, coalesce(n, 0) AS n_shingles, m AS component_id, m = doc_id AS kept FROM documents LEFT JOIN n USING (doc_id) JOIN (SELECT id, min(m) AS m FROM r GROUP BY id) ON id = doc_id"""


# ------------------------------------------------------------ 9: secret scans


def op9_zstd_novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(read_table(spark, sf_dir, "documents"))
    of = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select(
        "doc_id", *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in secrets.KINDS],
        F.sha2(said(of(*secrets.KINDS[:3])), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))


# ---------------------------------------------------------------- 10: packing


def op10_variable_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"))


# ----------------------------------------------------------- 11: license scans


def op11_set_join_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.find_licenses(read_table(spark, sf_dir, "documents"))
    starts = F.transform("places", lambda p: p["start"])
    base = F.sort_array(F.array_distinct(F.transform("places", lambda p: p["label"])))
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score")


# every block against every template by counting shared words, every place of a phrase by its text
def _op11_sql() -> str:
    values = lambda rows: ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in row) + ")" for row in rows)
    tokens = [(t, label, w) for t, (label, words) in enumerate(licenses.TEMPLATES) for w in sorted(set(words.split()))]
    return f"""
    WITH d AS (SELECT row_number() OVER () AS nth, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{ascii_uppercase}', '{ascii_lowercase}'), '{licenses.WORD}') AS w FROM documents),
    u AS (SELECT nth, unnest(w) AS word, unnest(range(len(w))) AS pos FROM d),
    phrase AS (SELECT label, string_split(p, ' ') AS p FROM (VALUES {values(licenses.PHRASES)}) x(label, p)),
    place AS (SELECT u.nth, pos, label FROM u JOIN phrase ON word = p[1] JOIN d ON d.nth = u.nth WHERE w[pos + 1 : pos + len(p)] = p),
    base AS (SELECT nth, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM place GROUP BY nth),
    token AS (SELECT * FROM (VALUES {values(tokens)}) x(t, label, word)),
    share AS (SELECT t, label, count(*) AS n FROM token GROUP BY t, label),
    held AS (SELECT nth, block, t, count(DISTINCT word) AS held FROM (SELECT nth, word, pos // {licenses.STRIDE} - back AS block, t FROM u JOIN token USING (word), (VALUES (0), (1)) y(back)) WHERE block >= 0 GROUP BY ALL),
    met AS (SELECT nth, label, held / n AS part FROM held JOIN share USING (t) WHERE 100 * held >= {licenses.PERCENT} * n),
    best AS (SELECT nth, max(part) AS part FROM met GROUP BY nth),
    named AS (SELECT nth, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT nth, label FROM place UNION ALL SELECT nth, label FROM met) GROUP BY nth)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
        coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(part, 0) END::DOUBLE AS score
    FROM d LEFT JOIN base USING (nth) LEFT JOIN named USING (nth) LEFT JOIN best USING (nth)"""


# ------------------------------------------------ 12: conversation prefix trie


def op12_radix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = (F.crc32(F.col("conv").cast("string").cast("binary")) % 6).cast("int")
    return prefix_trie.conversation_trie(read_table(spark, sf_dir, "conversations"), F.col("conv") - F.col("conv") % 100, heads, most_heads=5)


def _crc32_sql(octets: str) -> str:
    """Unsigned crc32 of a list of octets; the query has to join _CRC_TABLE."""
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {octets}), lambda c, b: xor(c >> 8, crc.t[(xor(c & 255, b) + 1)::BIGINT])), 4294967295::BIGINT)"


_CRC_TABLE = "crc AS MATERIALIZED (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)"


# every beginning of every conversation, and every node once for each node on its way to the root
def _op12_sql() -> str:
    octets = "list_transform(range(1, length(conv::VARCHAR) + 1), lambda i: ascii(substr(conv::VARCHAR, i, 1))::BIGINT)"
    return f"""
    WITH {_CRC_TABLE},
    t AS (SELECT conv_id AS conv, coalesce(role, '') AS role, coalesce(text, '') AS said, turn FROM conversations WHERE conv_id IS NOT NULL),
    own AS (SELECT conv, list({{'r': role, 't': said}} ORDER BY turn NULLS FIRST, unhex(sha256(length(role) || ':' || role || said))) AS turns FROM t GROUP BY conv),
    h AS (SELECT conv, turns, {_crc32_sql(octets)} % 6 AS h FROM own, crc),
    c AS (SELECT h.conv, list_concat(coalesce(b.turns[1 : h], []), h.turns[h + 1 :]) AS turns FROM h LEFT JOIN own b ON b.conv = h.conv - h.conv % 100),
    begun AS (SELECT conv, len(turns) AS size, unnest(range(len(turns) + 1)) AS depth, turns FROM c),
    node AS MATERIALIZED (SELECT depth, turns[1 : depth] AS way, min(conv) AS conv_id, count(*) AS n_convs, coalesce(string_agg(conv::VARCHAR, ',' ORDER BY conv) FILTER (size = depth), '') AS ends,
        CASE WHEN depth > 0 THEN (count(*) - 1) * length(any_value(turns[depth].t)) ELSE 0 END AS saved FROM begun GROUP BY depth, turns[1 : depth]),
    kids AS (SELECT way[1 : depth - 1] AS way, depth - 1 AS depth, count(*) AS n_children FROM node WHERE depth > 0 GROUP BY ALL),
    known AS MATERIALIZED (SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN kids USING (depth, way)),
    sums AS (SELECT up AS depth, way[1 : up] AS way, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved) AS saved_tokens FROM (SELECT *, unnest(range(depth + 1)) AS up FROM known) GROUP BY ALL)
    SELECT known.conv_id, known.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, known.n_convs, known.n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens, sha256(known.ends) AS ends_sha256
    FROM known JOIN sums USING (depth, way) LEFT JOIN known p ON p.depth = known.depth - 1 AND p.way = known.way[1 : known.depth - 1]"""


# -------------------------------------------------- 13: spelling variants


def op13_wavelet_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variant_groups(spelling.count_words(read_table(spark, sf_dir, "documents")))


# near words by what is left when a letter goes: equal at the same place (replaced), or equal to the other word (inserted)
def _op13_sql() -> str:
    octets = "list_transform(range(octet_length(b)), lambda i: ('0x' || hex(array_slice(b, i + 1, i + 1)))::BIGINT)"
    return f"""
    WITH RECURSIVE {_CRC_TABLE},
    run AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')), '{ascii_uppercase}', '{ascii_lowercase}') AS run FROM documents),
    seen AS (SELECT run, times, length(run) AS size, {_crc32_sql(octets)} AS h FROM (SELECT run, count(*) AS times, encode(coalesce(doc_id::VARCHAR, '') || ':' || run) AS b FROM run WHERE length(run) >= 5 GROUP BY doc_id, run), crc),
    v AS MATERIALIZED (SELECT word, sum(times)::BIGINT AS n FROM (SELECT times, CASE WHEN h % 97 = 0 THEN substr(run, 1, h % size) || substr(run, h % size + 2) ELSE run END AS word FROM seen) WHERE length(word) >= 5 GROUP BY word HAVING sum(times) >= 3),
    less AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM v)),
    near AS (SELECT a.word, b.word AS other, b.n AS m FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
        UNION SELECT a.word, b.word, b.n FROM less a JOIN v b ON a.rest = b.word UNION SELECT b.word, a.word, a.n FROM less a JOIN v b ON a.rest = b.word),
    best AS (SELECT word, count(*) AS n_near, arg_min(other, (-m, encode(other))) AS form, max(m) AS form_n FROM near GROUP BY word),
    f AS MATERIALIZED (SELECT v.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 2 * n THEN form END AS form, CASE WHEN form_n >= 2 * n THEN form_n END AS form_n FROM v LEFT JOIN best USING (word)),
    way AS (SELECT word, word AS root FROM f UNION ALL SELECT way.word, f.form FROM way JOIN f ON f.word = way.root WHERE f.form IS NOT NULL)
    SELECT f.word, f.form, way.root, f.n, f.n_near, f.form_n FROM f JOIN way ON way.word = f.word JOIN f g ON g.word = way.root AND g.form IS NULL"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_hierarchical_mix": op1_hierarchical_mix,
    "op2_bitmask_ngrams": op2_bitmask_ngrams,
    "op3_improbable_features": op3_improbable_features,
    "op4_voronoi_knn": op4_voronoi_knn,
    "op5_sampled_splitters": op5_sampled_splitters,
    "op6_pitman_yor": op6_pitman_yor,
    "op7_relational_chat": op7_relational_chat,
    "op8_chosen_path": op8_chosen_path,
    "op9_zstd_novelty": op9_zstd_novelty,
    "op10_variable_best_fit": op10_variable_best_fit,
    "op11_set_join_licenses": op11_set_join_licenses,
    "op12_radix_trie": op12_radix_trie,
    "op13_wavelet_variants": op13_wavelet_variants,
}
ORACLE_SQL: dict[str, str] = {"op1_hierarchical_mix": _op1_sql(), "op4_voronoi_knn": _OP4_SQL, "op7_relational_chat": _op7_sql(), "op8_chosen_path": _OP8_SQL, "op11_set_join_licenses": _op11_sql(), "op12_radix_trie": _op12_sql(), "op13_wavelet_variants": _op13_sql()}
