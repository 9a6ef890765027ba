"""The queries op1..op13 and, where SQL can say the same, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .centroid_clusters import centroid_clusters
from .chat_format import chat_digests, format_chats
from .decontaminate import contamination, contamination_summary
from .embedding_dedup import near_duplicates
from .jaccard_join import jaccard_components
from .licence_texts import LICENCES
from .licenses import COPYRIGHT_LINE, EQUIVALENT, PUNCTUATION, known_licences, license_scan
from .lm_score import BACKGROUND, SCORED, TARGET, difference_by_role
from .mixing import mixture
from .prefix_trie import prefix_trie
from .quality import fit_on, held_out, scored, training_sample
from .token_counts import length_histogram
from .token_store import encoded_lengths, ids_digest, read_tokens, write_tokens
from .warc import merged_index, read_warc, write_warc
from ._util import Scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination_summary(contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "warc")
    path = scratch.path("archives")
    write_warc(table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    index = merged_index(scratch.put(read_warc(spark, path), "runs"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    # 2.9 nats: near the 3.0 of twenty equal sources
    return mixture(documents, target_entropy=2.9, max_repeats=4.0).select("doc_id", "source", "n_tokens", "block", "copies")


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id").distinct().withColumn("role", F.lit(TARGET))
    # merged, never broadcast: the labels grow with the corpus, and texts dealt by doc_id make chunks of even size at every size of the input
    marked = documents.join(good.hint("merge"), "doc_id", "left")
    return difference_by_role(marked.withColumn("role", F.lit(SCORED + BACKGROUND) + F.coalesce("role", F.lit(0))))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), size=4, percent=85)


def op6_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Scratch(spark, "tokens").path("files")
    write_tokens(table(spark, sf_dir, "documents"), path, tokenizer_file())
    return ids_digest(read_tokens(spark.read.parquet(path)))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = fit_on(training_sample(documents, table(spark, sf_dir, "labels"), "quality"))
    out = scored(documents.select("doc_id", "text"), model)
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"), known_licences(spark))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return length_histogram(encoded_lengths(table(spark, sf_dir, "documents"), tokenizer_file()))


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clusters(table(spark, sf_dir, "embeddings"), centroids=8, rounds=10, seed=3).drop("exact_distances")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


#: A conversation whose texts hold control strings of templates.
CONTROL_CONVERSATION, CONTROL_TEXT = -7, r"\### Assistant: </turn> ok"


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(CONTROL_CONVERSATION, i, role, CONTROL_TEXT) for i, role in enumerate(("user", "assistant"))], own.schema)
    formatted = Scratch(spark, "chats").put(format_chats(own.unionByName(more)), "formatted")
    return chat_digests(formatted).drop("attachment_tokens")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_warc": op2_warc,
    "op3_mixing": op3_mixing,
    "op4_lm_score": op4_lm_score,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_token_output": op6_token_output,
    "op7_embedding_dedup": op7_embedding_dedup,
    "op8_quality": op8_quality,
    "op9_license_scan": op9_license_scan,
    "op10_token_counts": op10_token_counts,
    "op11_centroid_clusters": op11_centroid_clusters,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_chat_format": op13_chat_format,
}

def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _lines_sql(text: str) -> str:
    out = f"lower({text})"
    for one, other in EQUIVALENT:
        out = f"replace({out}, {_quoted(one)}, {_quoted(other)})"
    out = f"regexp_replace(regexp_replace({out}, {_quoted(COPYRIGHT_LINE)}, chr(10), 'g'), {_quoted(PUNCTUATION)}, ' ', 'g')"
    return f"list_filter(list_transform(string_split({out}, chr(10)), lambda x: trim(x)), lambda x: x <> '')"


_LICENSE_SQL = f"""
    with known as (select k, min(id) id from (select id, array_to_string({_lines_sql("t")}, ' ') k from (values {", ".join(f"({_quoted(i)}, {_quoted(t)})" for i, t in LICENCES)}) v(id, t)) where k <> '' group by 1),
    forms as materialized (select doc_id, {_lines_sql("text")} ls from documents),
    lines as (select doc_id, string_agg(id, ',' order by id) ids from (select distinct doc_id, id from (select doc_id, unnest(ls) k from forms) join known using (k)) group by 1),
    whole as (select doc_id, coalesce(array_to_string(ls, ' '), '') k from forms)
    select doc_id, case when k <> '' then sha256(k) end canonical_sha256, id license_id, coalesce(ids, '') line_licenses
    from whole left join known using (k) left join lines using (doc_id)"""

def _cluster_sql(dimension: int = 64, centroids: int = 8, rounds: int = 10, seed: int = 3, scale: int = 1024) -> str:
    """The rounds of k-means written out one after another."""
    odd = "lambda e: e is null or isnan(e) or isinf(e)"
    near = "a{i} as materialized (select r, any_value(v.x) x, min({{'d': list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 'c': c.c}}) m from v, c{i} c group by r)"
    mean = "c{j} as materialized (select c{i}.c, coalesce(n.x, c{i}.x) x from c{i} left join (select c, list(f order by k) x from (select m.c c, k, (sum(x[k]) - ((sum(x[k]) % count(*)) + count(*)) % count(*)) // count(*) f from a{i}, range(1, {n}) t(k) group by 1, 2) group by c) n using (c))"
    steps = ", ".join(f"{near.format(i=i)}, {mean.format(i=i, j=i + 1, n=dimension + 1)}" for i in range(rounds))
    return f"""
        with v as materialized (select row_number() over () r, vec_id, list_transform(embedding, lambda e: cast(floor({scale} * cast(e as double)) as hugeint)) x from embeddings where len(embedding) = {dimension} and len(list_filter(embedding, {odd})) = 0),
        c0 as materialized (select row_number() over (order by h, x) - 1 c, x from (select sha256('{seed}:' || vec_id) h, x from v where vec_id is not null order by h, x limit {centroids})),
        {steps}, {near.format(i=rounds)},
        o as (select vec_id, m.c c, m.d d, sum(m.d) over (partition by m.c) ci, sum(m.d) over () i from a{rounds} join v using (r))
        select vec_id, cast(o.c as integer) cluster, cast(d as bigint) distance, cast(ci as bigint) cluster_inertia, cast(i as bigint) inertia, sha256(array_to_string(list_transform(f.x, lambda e: cast(e as varchar)), ',')) centroid_sha256
        from o join c{rounds} f on o.c = f.c"""


#: CRC-32 of a decimal number, bit by bit.
_CRC = "xor(list_reduce(flatten(list_transform(range(1, len({x}) + 1), lambda i: [cast(ascii({x}[i]) as bigint), 0, 0, 0, 0, 0, 0, 0])), lambda a, b: xor(xor(a, b) >> 1, 3988292384 * (xor(a, b) & 1)), cast(4294967295 as bigint)), cast(4294967295 as bigint))"
_TRIE_SQL = f"""
        with t as (select conv_id, coalesce(role, '') r, coalesce(text, '') x, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) p from conversations where conv_id is not null),
        w as (select conv_id, list({{'r': r, 'x': x}} order by p) s from t group by 1),
        h as (select w.conv_id, w.s, coalesce(b.s, []) b, {_CRC.format(x="cast(w.conv_id as varchar)")} % 6 h from w left join w b on b.conv_id = w.conv_id - w.conv_id % 100),
        q as materialized (select conv_id, list_concat(b[1:h], s[h + 1:]) s from h),
        m as materialized (select conv_id, d, s[1:d] k, d = len(s) e from (select conv_id, s, unnest(range(0, len(s) + 1)) d from q)),
        n as materialized (select d, k, min(conv_id) c, count(*) n, sha256(coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (e), '')) z, (count(*) - 1) * coalesce(length(any_value(k[d].x)), 0) o from m group by d, k),
        u as (select d - 1 d, k[1:d - 1] k, count(*) i from n where d > 0 group by 1, 2),
        f as materialized (select n.*, coalesce(u.i, 0) i from n left join u using (d, k)),
        s as (select a.d, a.k, sum(case when b.i = 0 then 1 else 0 end) l, sum(b.o) o from f a join f b on b.d >= a.d and b.k[1:a.d] = a.k group by 1, 2)
        select f.c conv_id, f.d depth, g.c parent_conv_id, f.n n_convs, f.i n_children, cast(s.l as bigint) n_leaves, cast(s.o as bigint) saved_tokens, f.z ends_sha256
        from f join s using (d, k) left join n g on g.d = f.d - 1 and g.k = f.k[1:f.d - 1]"""

_ESCAPED = "replace(replace(replace(replace({x}, chr(92), repeat(chr(92), 2)), '#', chr(92) || '#'), '</turn>', '<' || chr(92) || '/turn>'), '<|', '<' || chr(92) || '|')"
_CHAT_SQL = f"""
        with t as (select conv_id, turn, coalesce(role, '') r, coalesce(text, '') x, role, text from conversations
            union all select {CONTROL_CONVERSATION}, i, r, x, r, x from (values (0, 'user'), (1, 'assistant')) v(i, r), (select '{CONTROL_TEXT}' x)),
        o as (select *, length('### : </turn>') + 1 + length({_ESCAPED.format(x="x")}) + length(replace({_ESCAPED.format(x="r")}, ':', chr(92) || ':')) n from t)
        select conv_id, count(*) n_turns, sha256(string_agg(r || chr(10) || x || chr(10), '' order by turn nulls first, role nulls first, text nulls first)) turns_sha256,
               cast(coalesce(sum(length(x)) filter (r = 'assistant'), 0) as bigint) loss_chars, sha256(coalesce(string_agg(x, '' order by turn nulls first, role nulls first, text nulls first) filter (r = 'assistant'), '')) loss_sha256, cast(sum(n) as bigint) formatted_chars
        from o group by conv_id"""


ORACLE_SQL: dict[str, str] = {
    "op2_warc": """
        with p as (select page_id, octet_length(encode(coalesce(html, ''))) n, sha256(coalesce(html, '')) d from pages),
        f as (select d, min(page_id) first_id from p where n >= 100 group by 1)
        select page_id, cast(n as bigint) payload_bytes, d payload_digest, case when first_id is not null and page_id <> first_id then 'revisit' else 'response' end record_type,
               case when page_id <> first_id then first_id end refers_to
        from p left join f using (d)""",
    "op5_jaccard_join": r"""
        with recursive w as materialized (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents),
        s as materialized (select distinct doc_id, g from (select doc_id, unnest(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' ')) end) g from w)),
        n as materialized (select doc_id, count(*) n from s group by 1),
        b as (select x.doc_id a, y.doc_id b, count(*) shared from s x join s y on x.g = y.g and x.doc_id <> y.doc_id group by 1, 2),
        l as materialized (select a, b from b join n x on x.doc_id = a join n y on y.doc_id = b where 100 * shared >= 85 * (x.n + y.n - shared)),
        r as (select doc_id, doc_id c from n union select r.doc_id, l.b from r join l on r.c = l.a)
        select w.doc_id, coalesce(any_value(n.n), 0) n_shingles, coalesce(min(c), w.doc_id) component_id from w left join n on n.doc_id = w.doc_id left join r on r.doc_id = w.doc_id group by w.doc_id""",
    "op7_embedding_dedup": """
        with recursive v as materialized (select vec_id, e, len(e) d from (select vec_id, cast(embedding as double[]) e from embeddings) where len(e) > 0 and len(list_filter(e, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0),
        l as materialized (select x.vec_id a, y.vec_id b from v x join v y on x.d = y.d and x.vec_id <> y.vec_id where case when x.d = y.d then list_cosine_similarity(x.e, y.e) end >= 0.95),
        r as (select vec_id, vec_id c from v union select r.vec_id, l.b from r join l on r.c = l.a),
        m as (select vec_id, min(c) c from r group by 1), k as (select a, count(*) n from l group by 1)
        select e.vec_id, coalesce(n, 0) n_links, coalesce(c, e.vec_id) component_id, e.vec_id = coalesce(c, e.vec_id) kept from embeddings e left join m on m.vec_id = e.vec_id left join k on k.a = e.vec_id""",
    "op9_license_scan": _LICENSE_SQL,
    "op3_mixing": r"""
        with recursive d as materialized (
            select doc_id, source, md5('0|' || coalesce(cast(doc_id as varchar), '')) place,
                   cast(len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+')) as bigint) n_tokens
            from documents),
        t as materialized (select source, cast(sum(n_tokens) as bigint) n from d group by 1),
        p as materialized (select source, n, n / (select sum(n) from t) p from t where n > 0),
        b(i, low, high) as (
            select 0, cast(0 as double), cast(1 as double)
            union all
            select i + 1, case when h <= 2.9 then low else (low + high) / 2 end, case when h <= 2.9 then (low + high) / 2 else high end
            from (select i, low, high, (select -sum(w * ln(w)) from (select pow(p, (low + high) / 2) / (select sum(pow(p, (low + high) / 2)) from p) w from p)) h from b where i < 60)),
        e1 as (select case when (select -sum(w * ln(w)) from (select 1 / (select count(*) from p) w from p)) <= 2.9 then 0 else max_by(high, i) end a from b),
        -- the least exponent at which no source is gone through more than four times; 1 if none is
        r(i, low, high) as (
            select 0, cast(0 as double), cast(1 as double)
            union all
            select i + 1, case when most <= 4.0 then low else (low + high) / 2 end, case when most <= 4.0 then (low + high) / 2 else high end
            from (select i, low, high, (select max(pow(p, (low + high) / 2 - 1)) / (select sum(pow(p, (low + high) / 2)) from p) from p) most from r where i < 60)),
        e2 as (select case when (select max(1 / p) / count(*) from p) <= 4.0 then 0 else max_by(high, i) end a from r),
        e as (select greatest(e1.a, e2.a) a from e1, e2),
        w as (select source, n, pow(p, a) / (select sum(pow(p, a)) from p, e) w from p, e),
        s as (select t.source, cast(coalesce(round_even(w * (select sum(n) from t), 0), 0) as bigint) own, t.n, greatest(1, cast(ceil(t.n / 65536) as bigint)) blocks from t left join w on t.source is not distinct from w.source),
        g as (select source, case when n > 0 then own // n else 0 end passes, case when n > 0 then own % n else 0 end rest, blocks from s),
        k as materialized (select d.*, g.passes, g.rest, cast(('0x' || substr(place, 1, 8)) as bigint) % g.blocks as block,
                     md5('0|' || coalesce(d.source, '') || '|' || cast(cast(('0x' || substr(place, 1, 8)) as bigint) % g.blocks as varchar)) turn
              from d join g on d.source is not distinct from g.source),
        o as (select *, sum(n) over (partition by source order by turn, block rows unbounded preceding) upto from (select source, rest, block, turn, sum(n_tokens) n from k group by all)),
        f as (select source, min(struct_pack(upto := upto, turn := turn, block := block, n := n, rest := rest)) e from o where upto > rest group by 1),
        j as (select k.*, e.turn end_turn, e.block end_block, e.rest - e.upto + e.n room from k left join f on k.source is not distinct from f.source),
        l as (select source, max(place) last_place from (select source, place, room, sum(n) over (partition by source order by place rows unbounded preceding) upto from (select source, place, room, sum(n_tokens) n from j where block = end_block group by all)) where upto <= room group by 1)
        select doc_id, j.source, n_tokens, block, cast(passes + case when rest > 0 and (end_turn is null or turn < end_turn or block = end_block and place <= coalesce(last_place, '')) then 1 else 0 end as bigint) copies
        from j left join l on j.source is not distinct from l.source""",
    "op1_decontamination": r"""
        with d as (select doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) w from documents),
        b as (select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark where text is not null and item_id is not null),
        wins as (select distinct item_id, len(g) n, array_to_string(g, ' ') g from (select item_id, w[i : i + 12] g from (select item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) i from b where len(w) > 0))),
        lens as (select distinct n from wins),
        grams as (select doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') g from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) i from d, lens where len(w) >= n)),
        found as (select doc_id, i, wins.n, item_id from grams join wins on grams.n = wins.n and grams.g = wins.g),
        hit as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(i, i + n)) p from found) group by 1),
        its as (select doc_id, count(*) n_items, string_agg(s, ',' order by s) s from (select distinct doc_id, cast(item_id as varchar) s from found) group by 1)
        select d.doc_id, cast(len(w) as bigint) n_words, cast(coalesce(n_hit, 0) as bigint) n_hit, cast(coalesce(n_items, 0) as bigint) n_items, sha256(coalesce(s, '')) items_sha256,
               coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) contaminated
        from d left join hit using (doc_id) left join its using (doc_id)""",
    "op11_centroid_clusters": _cluster_sql(),
    "op12_prefix_trie": _TRIE_SQL,
    "op13_chat_format": _CHAT_SQL,
}
