"""The queries over the shared tables, and SQL that gives the same rows where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsgraph.llm import chat, decontaminate, imatch, katz, langid, merkle, pieces, quality, secretscan, simhash, suffixdedup, toxicity, whitening
from opsgraph.llm.common import fold, saved, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    corpus = langid.training_text(docs.where(fold("doc_id", 4) != 2))
    return langid.identify(docs.select("doc_id", "text"), corpus).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secretscan.find(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "secret_base", "secret_spans")
    counts = [secretscan.counted("secret_base", k).alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, F.sha2(secretscan.listed("secret_base"), 256).alias("base_sha256"), secretscan.listed("secret_spans").alias("spans"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.score(docs, quality.learn(docs)).select("doc_id", F.col("quality").alias("score"), (F.col("quality") >= 0.5).cast("int").alias("predicted"))


def op4_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each conversation with an answer, beside one that begins alike: the prompt, and each completion with the code points that count for a loss."""
    talks = chat.conversations(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    found = chat.preferences(chat.pairs(talks))
    text = lambda side: F.array_join(F.transform(f"{side}_segments", lambda s: s["text"]), "")
    counted = lambda side: F.aggregate(f"{side}_segments", F.lit(0), lambda a, s: a + F.length(s["text"]) * s["loss"]).cast("long")
    return found.select("conv_id", F.coalesce("other", "conv_id").alias("other_id"), F.col("common_turns").cast("long").alias("common_turns"), "prompt", text("chosen").alias("chosen"), text("rejected").alias("rejected"), counted("chosen").alias("chosen_loss_chars"), counted("rejected").alias("rejected_loss_chars"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.learn(docs, toxicity.learnable(table(spark, sf_dir, "labels")))
    scored = toxicity.score(docs, model).withColumnRenamed("toxicity", "score")
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op6_suffixdedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixdedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate(F.zip_with("starts", "ends", lambda s, e: e - s), F.lit(0).cast("long"), lambda a, x: a + x)
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and benchmark item that leaks into it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.leaks(docs, table(spark, sf_dir, "benchmark")).where(F.size("leaked_items") > 0)
    each = found.select("doc_id", F.explode(F.arrays_zip("leaked_items", "leaked_matched", "leaked_tokens")).alias("x"))
    return each.select("doc_id", F.col("x.leaked_items").alias("item_id"), F.col("x.leaked_matched").alias("n_matched"), F.col("x.leaked_tokens").alias("n_tokens"))


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each whole text: how many pieces, a digest of their ids, and whether decoding gives the text back."""
    encoded = pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), verify=True)
    return encoded.select("doc_id", F.coalesce(F.size("piece_ids"), F.lit(0)).cast("long").alias("n_pieces"), F.sha2(F.array_join(F.col("piece_ids").cast("array<string>"), ","), 256).alias("ids_sha256"), "lossless")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    prints = saved(simhash.prints(docs), "keys")
    found = simhash.grouped(prints)
    return found.select(F.col("_key").alias("doc_id"), simhash.hex_digits("_f").alias("fingerprint"), F.col("_component").alias("component_id"))


def op10_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return imatch.edited_neighbours(docs, imatch.lexicon(docs))


#: Rows whose id has a crc32 divisible by this are presented with another n_chars.
TAMPERED = 7


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*merkle.COLUMNS)
    other = F.when(fold("doc_id", TAMPERED) == 0, F.try_add("n_chars", F.lit(1).cast("long"))).otherwise(F.col("n_chars"))
    return merkle.manifest(docs, claim={"n_chars": other}).drop("lang")


def op12_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model, scores = katz.learned_and_scored(katz.blocks(docs, train=fold("doc_id", 5) != 1))
    held_out = F.coalesce(fold("doc_id", 5) == 1, F.lit(False)).alias("held_out")
    return scores.select("doc_id", held_out, "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.components(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


QUERIES: dict[str, Query] = {
    "op1_langid": op1_langid,
    "op2_secrets": op2_secrets,
    "op3_quality": op3_quality,
    "op4_preferences": op4_preferences,
    "op5_toxicity": op5_toxicity,
    "op6_suffixdedup": op6_suffixdedup,
    "op7_decontaminate": op7_decontaminate,
    "op8_pieces": op8_pieces,
    "op9_simhash": op9_simhash,
    "op10_imatch": op10_imatch,
    "op11_merkle": op11_merkle,
    "op12_katz": op12_katz,
    "op13_whitening": op13_whitening,
}

def _matches_sql(pattern: str, group: int, least: int, below: int, kind: int) -> str:
    """DuckDB: the matches of a pattern as a list of structs; ends by summing the lengths of what precedes."""
    p = "'" + pattern.replace("'", "''") + "'"
    return f"""list_filter(list_transform(range(1, len(regexp_extract_all(t, {p})) + 1), lambda i: {{
        's': cast(coalesce(list_sum(list_transform(list_slice(string_split_regex(t, {p}), 1, i), lambda x: length(x))), 0) + coalesce(list_sum(list_transform(list_slice(regexp_extract_all(t, {p}), 1, i - 1), lambda x: length(x))), 0) AS bigint),
        'k': {kind},
        'e': cast(coalesce(list_sum(list_transform(list_slice(string_split_regex(t, {p}), 1, i), lambda x: length(x))), 0) + list_sum(list_transform(list_slice(regexp_extract_all(t, {p}), 1, i), lambda x: length(x))) AS bigint),
        'v': length(regexp_extract_all(t, {p}, {group})[i])}}), lambda m: m.v >= {least} AND m.v < {below})"""


def _secrets_sql() -> str:
    letters = lambda w: "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in w)
    assign = "(" + "|".join(map(letters, ("password", "passwd", "secret", "token", "api_?key"))) + ")" + secretscan.ASSIGN.partition("key)")[2]
    ident = "(" + "|".join(map(letters, ("access_?key_?id", "client_?id", "username", "login"))) + ")" + secretscan.IDENT.partition("login)")[2]
    most = 1 << 30
    m = lambda *a: _matches_sql(*a)
    near = lambda parts: f"len(list_filter({parts}, lambda y: abs(y.s - x.s) <= {secretscan.SCOPE})) > 0"
    text = lambda spans: f"coalesce(array_to_string(list_transform({spans}, lambda x: ['assign','access','hex','ident','secret','endpoint'][x.k + 1] || ':' || cast(x.s AS bigint) || ':' || cast(x.e AS bigint)), ','), '')"
    clear = lambda l: f"list_filter({l}, lambda x: len(list_filter(base, lambda y: y.s < x.e AND x.s < y.e)) = 0)"
    return f"""
WITH t0 AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
t1 AS (SELECT doc_id,
    {m(assign, 2, secretscan.ASSIGN_LEAST, most, 0)} AS a, {m(secretscan.ACCESS, 1, secretscan.ACCESS_LEAST, most, 1)} AS k, {m(secretscan.HEX, 1, 0, most, 2)} AS h,
    list_concat({m(secretscan.ACCESS, 1, secretscan.ACCESS_WEAK, secretscan.ACCESS_LEAST, 3)}, {m(ident, 2, secretscan.IDENT_LEAST, most, 3)}) AS i,
    list_concat({m(assign, 2, secretscan.ASSIGN_WEAK, secretscan.ASSIGN_LEAST, 4)}, {m(secretscan.BARE, 1, 0, most, 4)}) AS s,
    {m(secretscan.ENDPOINT, 1, 0, most, 5)} AS e FROM t0),
t2 AS (SELECT *, list_sort(list_concat(list_concat(a, k), h)) AS base FROM t1),
t3 AS (SELECT doc_id, a, k, h, base, {clear('i')} AS i, {clear('s')} AS s, {clear('e')} AS e FROM t2),
t4 AS (SELECT *, list_concat(k, i) AS ic, list_concat(list_concat(a, h), s) AS sc FROM t3),
t5 AS (SELECT *, list_sort(list_concat(base, list_concat(list_filter(i, lambda x: {near('sc')}), list_concat(list_filter(s, lambda x: {near('ic')}), list_filter(e, lambda x: {near('ic')} AND {near('sc')}))))) AS spans FROM t4)
SELECT doc_id, cast(len(a) AS bigint) AS n_assign, cast(len(k) AS bigint) AS n_access, cast(len(h) AS bigint) AS n_hex, sha256({text('base')}) AS base_sha256, {text('spans')} AS spans FROM t5"""


def _preferences_sql() -> str:
    show = lambda turns: f"coalesce(array_to_string(list_transform({turns}, lambda t: '{chat.OPEN}' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10)), ''), '')"
    loss = lambda turns: f"cast(coalesce(list_sum(list_transform(list_filter({turns}, lambda t: t.role = 'assistant'), lambda t: length(t.text) + {len(chat.CLOSE)})), 0) AS bigint)"
    said = lambda turns: f"coalesce(list_sum(list_transform(list_filter({turns}, lambda t: t.role = 'assistant'), lambda t: length(t.text))), 0)"
    return f"""
WITH t AS (SELECT conv_id, list({{'o': turn, 'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST, role, text) AS turns FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
s AS (SELECT conv_id, list_transform(turns, lambda x: {{'role': x.role, 'text': x.text}}) AS turns, list_filter(range(1, len(turns) + 1), lambda i: turns[i].role = 'assistant') AS said FROM t),
c AS (SELECT conv_id, turns[1:said[-1]] AS turns, said FROM s WHERE len(said) > 0),
f AS (SELECT conv_id, turns, d, turns[1:d] AS p FROM (SELECT *, unnest(range(1, len(turns) + 1)) AS d FROM c)),
g AS (SELECT d, p, min(m) AS a, max(m) AS b FROM (SELECT d, p, turns, min(conv_id) AS m FROM f GROUP BY ALL) GROUP BY d, p HAVING min(m) <> max(m)),
m AS (SELECT f.conv_id, max_by({{'a': a, 'b': b}}, f.d) AS g FROM f JOIN g ON f.d = g.d AND f.p = g.p GROUP BY f.conv_id),
o AS (SELECT m.conv_id, CASE WHEN c.turns = l.turns THEN m.g.b ELSE m.g.a END AS other FROM m JOIN c USING (conv_id) JOIN c l ON l.conv_id = m.g.a),
w AS (SELECT c.conv_id, o.other, c.turns, c.said, x.turns AS theirs, {said('c.turns')} AS i, {said('x.turns')} AS j, cast(list_sum(list_transform(c.turns, lambda t: length(t.text))) % len(c.said) AS bigint) AS br FROM c LEFT JOIN o USING (conv_id) LEFT JOIN c x ON x.conv_id = o.other),
p AS (SELECT conv_id, other, CASE WHEN other IS NULL OR i > j OR (i = j AND conv_id < other) THEN turns ELSE theirs END AS a,
    CASE WHEN other IS NULL THEN list_append(turns[1:said[br + 1] - 1], {{'role': 'assistant', 'text': CASE WHEN br > 0 THEN turns[said[br]].text ELSE '' END}}) WHEN i > j OR (i = j AND conv_id < other) THEN theirs ELSE turns END AS b FROM w),
n AS (SELECT *, coalesce(list_min(list_filter(range(1, len(a) + 1), lambda i: a[i] IS DISTINCT FROM b[i])) - 1, len(a)) AS n FROM p)
SELECT conv_id, coalesce(other, conv_id) AS other_id, cast(n AS bigint) AS common_turns, {show('a[1:n]')} AS prompt, {show('a[n + 1:]')} AS chosen, {show('b[n + 1:]')} AS rejected,
    {loss('a[n + 1:]')} AS chosen_loss_chars, {loss('b[n + 1:]')} AS rejected_loss_chars FROM n"""


def _merkle_sql() -> str:
    told = " || ".join(f"coalesce(strlen(cast({{{c}}} AS varchar)) || ':' || cast({{{c}}} AS varchar), '-')" for c in merkle.COLUMNS)
    own = {c: c for c in merkle.COLUMNS}
    leaf, claim = f"sha256({told.format(**own)})", f"sha256({told.format(**own | {'n_chars': 'n_chars + 1'})})"
    # crc32 of the id's digits, bit by bit.
    byte = "list_reduce(range(0, 8), lambda c, i: xor(c // 2, CASE WHEN c % 2 = 1 THEN 3988292384 ELSE 0 END), xor(c, x))"
    crc = f"xor(list_reduce(list_transform(string_split(cast(doc_id AS varchar), ''), lambda s: cast(ascii(s) AS bigint)), lambda c, x: {byte}, 4294967295), 4294967295)"
    climb = lambda leaves: f"(SELECT tree, 0 AS level, pos, n, digest FROM {leaves} UNION ALL SELECT tree, level + 1, pos // 2, any_value((n + 1) // 2), sha256(string_agg(digest, '' ORDER BY pos)) FROM {{0}} WHERE n > 1 GROUP BY tree, level, pos // 2)"
    return f"""
WITH RECURSIVE l AS (SELECT doc_id, coalesce('=' || lang, '-') AS tree, {leaf} AS digest, CASE WHEN ({crc}) % {TAMPERED} = 0 THEN {claim} ELSE {leaf} END AS claim FROM documents),
o AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, digest) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM l),
a(tree, level, pos, n, digest) AS {climb('o').format('a')},
s AS (SELECT '' AS tree, tree AS own, row_number() OVER (ORDER BY encode(tree)) - 1 AS pos, count(*) OVER () AS n, digest FROM a WHERE n = 1),
b(tree, level, pos, n, digest) AS {climb('s').format('b')},
w AS (SELECT o.tree, o.pos, level AS step, o.pos >> level AS here, a.pos AS other, a.digest FROM o JOIN a ON a.tree = o.tree AND a.n > 1 AND a.pos = xor(o.pos >> level, 1)),
v AS (SELECT s.own AS tree, level AS step, s.pos >> level AS here, b.pos AS other, b.digest FROM s JOIN b ON b.n > 1 AND b.pos = xor(s.pos >> level, 1)),
z AS (SELECT tree, max(level) AS top FROM a GROUP BY tree),
e AS (SELECT tree, pos, step, here, other, digest FROM w UNION ALL SELECT o.tree, o.pos, z.top + step, here, other, v.digest FROM o JOIN z ON z.tree = o.tree JOIN v ON v.tree = o.tree),
h AS (SELECT z.tree, z.top + (SELECT max(level) FROM b) AS steps FROM z),
p AS (SELECT tree, pos, sha256(string_agg(digest, '' ORDER BY step)) AS proof FROM e GROUP BY tree, pos),
f(tree, pos, step, digest) AS (SELECT tree, pos, 0::bigint, claim FROM o UNION ALL SELECT f.tree, f.pos, f.step + 1, sha256(CASE WHEN e.other IS NULL THEN f.digest WHEN e.other < e.here THEN e.digest || f.digest ELSE f.digest || e.digest END) FROM f JOIN h ON h.tree = f.tree AND f.step < h.steps LEFT JOIN e ON e.tree = f.tree AND e.pos = f.pos AND e.step = f.step)
SELECT o.doc_id, o.digest AS leaf, s.digest AS subroot, r.digest AS root, coalesce(p.proof, sha256('')) AS proof_sha256, f.digest AS folded_root, f.digest = r.digest AS verified
FROM o JOIN s ON s.own = o.tree JOIN h ON h.tree = o.tree JOIN f ON f.tree = o.tree AND f.pos = o.pos AND f.step = h.steps CROSS JOIN (SELECT digest FROM b WHERE n = 1) r LEFT JOIN p ON p.tree = o.tree AND p.pos = o.pos"""


ORACLES: dict[str, str] = {
    "op2_secrets": _secrets_sql(),
    "op4_preferences": _preferences_sql(),
    "op11_merkle": _merkle_sql(),
}
