"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, hard_negatives, jaccard_join, language_id, main_text, media, merkle, mixing, secrets, sentence_pieces, sharding, token_store, toxicity
from .common import table

SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def tokenizer_path(name: str) -> str:
    """A public tokenizer's file; only paths given to the operators come from here."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan_secrets(table(spark, sf_dir, "documents")))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("source")


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_components(table(spark, sf_dir, "documents"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), shards=16)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.report(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op7_media_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no images: every embedding is drawn as one, and those with ids divisible by 50 once more, edited."""
    return media.find_edits(table(spark, sf_dir, "embeddings"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.store_and_read(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup_report(table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"), merkle.tampered())


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of ids divisible by 7 are moved on; anchors are the ids divisible by 50."""
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.withColumn("label", moved), F.col("vec_id") % 50 == 0)


def op13_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract(table(spark, sf_dir, "pages"))


QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_mixing": op2_mixing,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_sharding": op4_sharding,
    "op5_toxicity": op5_toxicity,
    "op6_sentence_pieces": op6_sentence_pieces,
    "op7_media_copies": op7_media_copies,
    "op8_language_id": op8_language_id,
    "op9_token_store": op9_token_store,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_main_text": op13_main_text,
}

#: Letters that op3 lower-cases.
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

def _matches(kind: int, pattern: str, group: int, least: int) -> str:
    """Spans of one kind: a match starts where the parts between the matches and the matches before it end."""
    pattern = pattern.replace("'", "''")
    upto = lambda column, last: f"coalesce(list_sum(list_transform({column}[1:{last}], lambda z: length(z))), 0)"
    return f"""SELECT doc_id, owner, repo, {kind} AS kind, CAST({upto("parts", "i")} + {upto("found", "i - 1")} AS BIGINT) AS start, length(found[i]) AS size, vals[i] AS value
        FROM (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM (SELECT *, string_split_regex(s, '{pattern}') AS parts, regexp_extract_all(s, '{pattern}') AS found, regexp_extract_all(s, '{pattern}', {group}) AS vals FROM t)) WHERE length(vals[i]) >= {least}"""


def _leaf(text: str) -> str:
    fields = ["CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text]
    return "sha256(" + " || ".join(f"coalesce(CAST(strlen({f}) AS VARCHAR) || ':' || {f}, '-')" for f in fields) + ")"


def _levels(name: str, bottom: str) -> str:
    """The levels of trees whose bottom is the table `bottom` (tree, pos, n, node)."""
    return f"""{name} AS (SELECT 0 AS level, tree, pos, n, node FROM {bottom} UNION ALL
        SELECT any_value(level) + 1, tree, pos // 16, (any_value(n) + 15) // 16, sha256(string_agg(node, '' ORDER BY pos)) FROM {name} WHERE n > 1 GROUP BY tree, pos // 16)"""


ORACLE_SQL = {
    "op1_secret_scan": f"""
        WITH t AS (SELECT doc_id, coalesce(text, '') AS s, coalesce(CAST(source AS VARCHAR), '?') AS owner, CAST(doc_id AS VARCHAR) AS repo FROM documents),
        base AS ({_matches(0, "(?i)" + secrets.ASSIGN, 2, 6)} UNION ALL {_matches(1, secrets.ACCESS, 0, 20)} UNION ALL {_matches(2, "[0-9a-f]{24,}", 0, 24)}),
        bare AS (SELECT * FROM ({_matches(3, secrets.BARE, 0, 20)}) x WHERE regexp_matches(value, '[0-9]') AND value <> lower(value) AND value <> upper(value)
                 AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = x.doc_id AND b.start < x.start + x.size AND x.start < b.start + b.size)),
        every AS (SELECT * FROM base UNION ALL SELECT * FROM bare),
        freq AS (SELECT value, CASE WHEN count(DISTINCT owner) >= 3 OR count(DISTINCT (owner, repo)) >= 20 THEN 'example' WHEN count(DISTINCT owner) = 1 THEN 'live' ELSE 'shared' END AS status FROM every GROUP BY 1),
        kept AS (SELECT e.*, f.status, ['assign', 'access', 'hex', 'owned'][kind + 1] || ':' || start || ':' || (start + size) AS shown FROM every e JOIN freq f USING (value) WHERE kind < 3 OR status = 'live'),
        r AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, string_agg(shown, ',' ORDER BY start, kind) FILTER (kind < 3) AS b,
                     string_agg(shown, ',' ORDER BY start, kind) AS spans, count(*) FILTER (status = 'live') AS n_live, count(*) FILTER (status = 'shared') AS n_shared, count(*) FILTER (status = 'example') AS n_example FROM kept GROUP BY 1)
        SELECT t.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans,
               coalesce(n_live, 0) AS n_live, coalesce(n_shared, 0) AS n_shared, coalesce(n_example, 0) AS n_example FROM t LEFT JOIN r USING (doc_id)""",
    "op3_jaccard_join": rf"""
        WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '{SPACE_CLASS}+'), lambda x: x <> '') AS w FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS g FROM d),
        x AS (SELECT doc_id, len(g) AS n, unnest(g) AS shingle FROM s),
        pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common, any_value(a.n) AS na, any_value(b.n) AS nb FROM x a JOIN x b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
        links AS (SELECT a, b FROM pairs WHERE 100 * common >= 80 * (na + nb - common) UNION SELECT b, a FROM pairs WHERE 100 * common >= 80 * (na + nb - common)),
        reach AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
        SELECT s.doc_id, CAST(len(g) AS BIGINT) AS n_shingles, least(s.doc_id, min(r.b)) AS component_id FROM s JOIN reach r ON r.a = s.doc_id GROUP BY s.doc_id, len(g)""",
    "op11_merkle_manifest": f"""
        WITH RECURSIVE low AS (SELECT *, translate(text, '{_UPPER}', '{_UPPER.lower()}') AS lower_text FROM documents),
        d AS (SELECT doc_id, source, {_leaf("text")} AS leaf, {_leaf("lower_text")} AS lowered, row_number() OVER (ORDER BY doc_id) AS id FROM low),
        b AS (SELECT *, CAST(dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS BIGINT) AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
                     count(*) OVER (PARTITION BY source) AS n FROM d),
        bottom AS (SELECT tree, pos, n, leaf AS node FROM b),
        {_levels("own", "bottom")},
        tops AS (SELECT CAST(0 AS BIGINT) AS tree, tree AS pos, count(*) OVER () AS n, node FROM own WHERE n = 1),
        {_levels("upper", "tops")},
        root AS (SELECT node FROM upper WHERE n = 1),
        crc AS (SELECT i, list_reduce(list_prepend(CAST(i AS UBIGINT), range(8)::UBIGINT[]), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i)),
        crcs AS (SELECT list(v ORDER BY i) AS t FROM crc),
        hit AS (SELECT id, xor(list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS UBIGINT))),
                       lambda c, x: xor(t[CAST((xor(c, x) & 255) AS BIGINT) + 1], c >> 8)), CAST(4294967295 AS UBIGINT)) % 5 = 0 AS is_hit FROM d, crcs),
        up(level, tree, pos, n, i, before, after, high) AS (
            SELECT level, tree, pos, n, pos, coalesce(string_agg(node, '') OVER (PARTITION BY level, tree, pos // 16 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), ''),
                   coalesce(string_agg(node, '') OVER (PARTITION BY level, tree, pos // 16 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), ''), false FROM own WHERE n > 1
            UNION ALL
            SELECT level, tree, pos, n, pos, coalesce(string_agg(node, '') OVER (PARTITION BY level, tree, pos // 16 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), ''),
                   coalesce(string_agg(node, '') OVER (PARTITION BY level, tree, pos // 16 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), ''), true FROM upper WHERE n > 1),
        steps AS (SELECT b.id, up.high, up.level, before, after FROM b JOIN up ON NOT up.high AND up.tree = b.tree AND up.pos = b.pos // CAST(power(16, up.level) AS BIGINT)
                  UNION ALL SELECT b.id, up.high, up.level, before, after FROM b JOIN up ON up.high AND up.pos = b.tree // CAST(power(16, up.level) AS BIGINT)),
        path AS (SELECT id, list({{'before': before, 'after': after}} ORDER BY high, level) AS p, string_agg(before || after, '' ORDER BY high, level) AS joined FROM steps GROUP BY id),
        start AS (SELECT b.*, coalesce(path.p, []) AS p, coalesce(path.joined, '') AS joined, CASE WHEN coalesce(is_hit, false) THEN lowered ELSE leaf END AS seen FROM b LEFT JOIN path USING (id) LEFT JOIN hit USING (id)),
        fold AS (SELECT id, 0 AS k, seen AS node FROM start UNION ALL SELECT f.id, k + 1, sha256(s.p[k + 1].before || f.node || s.p[k + 1].after) FROM fold f JOIN start s USING (id) WHERE k < len(s.p)),
        folded AS (SELECT id, arg_max(node, k) AS folded_root FROM fold GROUP BY id)
        SELECT doc_id, leaf, tops.node AS subroot, root.node AS root, sha256(joined) AS proof_sha256, folded_root, folded_root = root.node AS verified
        FROM start JOIN folded USING (id) JOIN tops ON tops.pos = start.tree CROSS JOIN root""",
    "op12_hard_negatives": """
        WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
                   FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT a.vec_id AS anchor_id, a.label AS anchor_label, b.vec_id, b.label, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
        p AS (SELECT *, vec_id AS positive_id, score AS positive_score FROM s WHERE label = anchor_label QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
        n AS (SELECT p.anchor_id, p.positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS rank, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
              FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.label <> p.anchor_label AND 100 * s.score BETWEEN 50 * p.positive_score AND 95 * p.positive_score)
        SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3""",
    "op10_exact_dedup": rf"""
        WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '{SPACE_CLASS}', '', 'g') AS norm FROM documents),
        w AS (SELECT doc_id, norm, first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS keep_id,
                     count(*) OVER (PARTITION BY norm) AS group_size FROM d)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM w""",
}
