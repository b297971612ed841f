"""The queries p6_ to p8_ over the text tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackweave.llm import mixing, packing, splitting, tokens
from trackweave.runtime import cut, params
from trackweave.sources.tables import read


def _packed(s: SparkSession, d: str) -> DataFrame:
    kinds = [(r["container_id"], r["capacity_tokens"]) for r in params(read(s, d, "pack_containers"))]
    return packing.pack(read(s, d, "documents"), sorted(kinds))


def p6_found(s: SparkSession, d: str) -> DataFrame:
    return packing.cut_documents(_packed(s, d))


def p6_pack(s: SparkSession, d: str) -> DataFrame:
    """Which document or piece lies in which container."""
    return _packed(s, d)


def p6_fill(s: SparkSession, d: str) -> DataFrame:
    """Per kind of container: how many are used, what they hold and the share of room used."""
    kinds = read(s, d, "pack_containers").select("container_id", "label", "capacity_tokens")
    used = packing.containers(_packed(s, d)).groupBy("container_id").agg(
        F.count("*").alias("n_containers"),
        F.sum("n_items").alias("n_items"),
        F.sum("n_tokens").alias("n_tokens"),
        F.max("n_tokens").alias("largest"),
    )
    return kinds.join(used, "container_id", "left").withColumn(
        "fill", F.col("n_tokens") / (F.col("n_containers") * F.col("capacity_tokens"))
    )


def p6_checks(s: SparkSession, d: str) -> DataFrame:
    """Per kind of container: documents, pieces and tokens packed, containers above the capacity and documents whose
    packed tokens aren't their size (both none)."""
    kinds = F.broadcast(read(s, d, "pack_containers").select("container_id", "capacity_tokens"))
    packed = cut(_packed(s, d))
    over = packing.containers(packed).join(kinds, "container_id").groupBy("container_id").agg(
        F.count_if(F.col("n_tokens") > F.col("capacity_tokens")).alias("n_over")
    )
    sizes = read(s, d, "documents").select("doc_id", tokens.size("text").alias("size"))
    whole = packed.groupBy("container_id", "doc_id").agg(F.count("*").alias("pieces"), F.sum("n_tokens").alias("got"))
    per = whole.join(sizes, "doc_id").groupBy("container_id").agg(
        F.count("*").alias("n_docs"),
        F.sum("pieces").alias("n_pieces"),
        F.sum("got").alias("n_tokens"),
        F.count_if(F.col("got") != F.col("size")).alias("n_wrong"),
    )
    return per.join(over, "container_id")


def _mixed(s: SparkSession, d: str, **options) -> mixing.Mixed:
    targets = [mixing.Target(r["source"], r["target_share"], r["max_repeats"]) for r in params(read(s, d, "mix_targets"))]
    return mixing.mix(read(s, d, "documents"), sorted(targets, key=lambda t: t.source), **options)


def p7_found(s: SparkSession, d: str) -> DataFrame:
    return _mixed(s, d).shares.where("short").select("source")


def p7_mix(s: SparkSession, d: str) -> DataFrame:
    """The chosen documents with their repeats."""
    return _mixed(s, d).chosen


def p7_shares(s: SparkSession, d: str) -> DataFrame:
    """What every source was to reach and reaches."""
    return _mixed(s, d).shares


def p7_soft(s: SparkSession, d: str) -> DataFrame:
    """The mix with unlabelled documents given to their most probable source."""
    return _mixed(s, d, admit_unlabelled=True).chosen


def p7_recall(s: SparkSession, d: str) -> DataFrame:
    """Per source: how many documents the classifier trained on the other half of them names rightly."""
    return _mixed(s, d).recall


def p7_checks(s: SparkSession, d: str) -> DataFrame:
    """Per target: its documents and tokens; whether no document is used too often; and for each source that can be
    reached, whether the fitted rates meet its target within a hundredth and the chosen documents to the nearest one."""
    shares = _mixed(s, d).shares
    docs = read(s, d, "documents").groupBy(mixing.label("source").alias("name")).agg(F.max(tokens.size("text")).alias("largest"))
    targets = read(s, d, "mix_targets").select("source", "max_repeats")
    all_ = shares.join(F.broadcast(targets), "source").join(docs, mixing.label("source") == F.col("name"), "left")
    off = lambda c: F.abs(F.col(c) - F.col("target_tokens"))
    return all_.select(
        "source",
        "n_docs",
        "available_tokens",
        "reachable_tokens",
        (F.col("most_repeats") <= F.col("max_repeats")).alias("within_repeats"),
        (F.col("short") | (off("expected_tokens") <= F.col("target_tokens") * 0.01)).alias("expected_met"),
        F.coalesce(
            F.when(F.col("short"), F.col("reached_tokens") == F.col("reachable_tokens")).otherwise(off("reached_tokens") * 2 <= F.col("largest")),
            F.lit(False),
        ).alias("reached_met"),
    )


def _limits(s: SparkSession, d: str) -> list[tuple[int, int, int]]:
    return sorted((r["limit_id"], r["max_tokens"], r["overlap_tokens"]) for r in params(read(s, d, "piece_limits")))


def p8_found(s: SparkSession, d: str) -> DataFrame:
    limits = _limits(s, d)
    return splitting.oversized(splitting.split(read(s, d, "documents"), limits), limits)


def p8_pieces(s: SparkSession, d: str) -> DataFrame:
    """The pieces of every document above a limit, in order, with their texts."""
    limits = _limits(s, d)
    return splitting.pieces(splitting.split(read(s, d, "documents"), limits), limits)


def p8_checks(s: SparkSession, d: str) -> DataFrame:
    """Per limit: documents cut, their tokens as counted off by the pieces, pieces above the limit, pieces that don't
    share overlap_tokens (or up to three more) with the one before, and pieces that break a character (all none)."""
    limits = _limits(s, d)
    pieces = splitting.pieces(splitting.split(read(s, d, "documents"), limits), limits)
    dim = F.broadcast(read(s, d, "piece_limits"))
    before = F.lag("end_token").over(Window.partitionBy("limit_id", "doc_id").orderBy("piece_no"))
    rows = pieces.select(
        "limit_id", "doc_id", "piece_no", "start_token", "end_token", tokens.size("piece").alias("size"), F.coalesce(before, F.lit(0)).alias("before")
    ).join(dim, "limit_id")
    shared = F.col("before") - F.col("start_token")
    return rows.groupBy("limit_id").agg(
        F.count_if(F.col("piece_no") == 0).alias("n_docs"),
        F.sum(F.col("end_token") - F.col("before")).alias("n_tokens"),
        F.count_if(F.col("end_token") - F.col("start_token") > F.col("max_tokens")).alias("n_over"),
        F.count_if((F.col("piece_no") > 0) & ~shared.between(F.col("overlap_tokens"), F.col("overlap_tokens") + 3)).alias("n_unshared"),
        F.count_if(F.col("size") != F.col("end_token") - F.col("start_token")).alias("n_broken"),
    )


QUERIES = {f.__name__: f for f in (p6_found, p6_pack, p6_fill, p6_checks, p7_found, p7_mix, p7_shares, p7_soft, p7_recall, p7_checks, p8_found, p8_pieces, p8_checks)}

ORACLES = {
    "p7_found": """SELECT t.source FROM mix_targets t LEFT JOIN documents d ON lower(trim(d.source)) = lower(trim(t.source))
      GROUP BY t.source, t.target_share, t.max_repeats
      HAVING coalesce(sum(strlen(d.text)), 0) * t.max_repeats < t.target_share * (SELECT sum(strlen(text)) FROM documents)""",
    "p7_checks": """SELECT t.source, count(d.text) AS n_docs, coalesce(sum(strlen(d.text)), 0)::BIGINT AS available_tokens,
        coalesce(sum(strlen(d.text)) * t.max_repeats, 0)::BIGINT AS reachable_tokens,
        true AS within_repeats, true AS expected_met, true AS reached_met
      FROM mix_targets t LEFT JOIN documents d ON lower(trim(d.source)) = lower(trim(t.source)) GROUP BY t.source, t.max_repeats""",
    "p6_checks": """SELECT c.container_id, count(*) AS n_docs,
        sum(greatest(1, (strlen(d.text) + c.capacity_tokens - 1) // c.capacity_tokens))::BIGINT AS n_pieces,
        sum(strlen(d.text))::BIGINT AS n_tokens, 0::BIGINT AS n_over, 0::BIGINT AS n_wrong
      FROM documents d JOIN pack_containers c ON d.text IS NOT NULL GROUP BY c.container_id""",
    "p6_found": """SELECT c.container_id, d.doc_id FROM documents d JOIN pack_containers c
      ON strlen(d.text) > c.capacity_tokens""",
    "p8_checks": """SELECT l.limit_id, count(*) AS n_docs, sum(strlen(d.text))::BIGINT AS n_tokens,
        0::BIGINT AS n_over, 0::BIGINT AS n_unshared, 0::BIGINT AS n_broken
      FROM documents d JOIN piece_limits l ON strlen(d.text) > l.max_tokens GROUP BY l.limit_id""",
    "p8_found": """WITH over AS (SELECT l.limit_id, l.max_tokens, d.doc_id, d.text FROM documents d
        JOIN piece_limits l ON strlen(d.text) > l.max_tokens),
      lines AS (SELECT limit_id, max_tokens, doc_id, unnest(string_split(text, chr(10))) AS line,
        generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM over)
      SELECT limit_id, doc_id, 0::BIGINT AS line_no FROM over
      UNION ALL SELECT limit_id, doc_id, line_no::BIGINT FROM lines WHERE strlen(line) > max_tokens""",
}
