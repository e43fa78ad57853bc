"""Semantic response cache: snapshot lookup and replay of a request log."""

from __future__ import annotations

from collections.abc import Callable
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convspark import values as V
from convspark.functions import text as X
from convspark.operators import similarity as S
from convspark.session import cut_lineage
from convspark.sources.sinks import kept


def bags(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, bag, sq) of the texts that have tokens; counting is map-side first."""
    tokens = rows.select(*keys, F.explode(X.tokens(F.col(text))).alias("token"))
    words = tokens.groupBy(*keys, "token").agg(F.count("*").alias("c"))
    bucket = (X.fnv1a32(F.col("token")) % V.EMBED_BUCKETS).cast("int")
    counts = words.select(*keys, bucket.alias("bucket"), "c").groupBy(*keys, "bucket").agg(F.sum("c").alias("w"))
    return S.bags(counts, keys)


def exact_hits(requests: DataFrame, entries: DataFrame) -> DataFrame:
    """(ns, request_id, entry_id) of the requests whose key text is stored; of equal keys the least recently touched."""
    digest = F.sha2("key_text", 256).alias("digest")
    first = F.min(F.struct("last_touch_seq", "entry_id", "key_text")).alias("e")
    known = entries.select("ns", digest, "last_touch_seq", "entry_id", "key_text").groupBy("ns", "digest").agg(first)
    asked = requests.select("ns", "request_id", "key_text", digest)
    same = asked.join(known, ["ns", "digest"]).filter(F.col("key_text") == F.col("e.key_text"))
    return same.select("ns", "request_id", F.col("e.entry_id").alias("entry_id"))


def lookup(requests: DataFrame, entries: DataFrame, threshold: float = 0.95) -> DataFrame:
    """Every request against a snapshot of entries in its namespace.

    ``requests``: ns, request_id, key_text. ``entries``: ns, entry_id, key_text, response, last_touch_seq. An equal key
    is an exact hit whatever the threshold; only the other requests go through the inverted index. Among equally
    similar entries the least recently touched one answers. A miss reports its best similarity.
    """
    if not 0.0 < threshold <= 1.0:
        raise ValueError(f"threshold must be in (0, 1], got {threshold}")
    # a prompt asked many times is judged once; the log itself meets the outcomes of its prompts only
    digest = F.sha2("key_text", 256).alias("key_id")
    prompts = cut_lineage(requests.select("ns", "key_text").distinct().select("ns", digest, "key_text"))
    exact = cut_lineage(exact_hits(prompts.withColumnRenamed("key_id", "request_id"), entries))
    exact = exact.withColumnRenamed("request_id", "key_id")
    rest = prompts.join(exact, ["ns", "key_id"], "left_anti")
    stored = entries.select("ns", "entry_id", F.col("last_touch_seq").alias("touch"), "key_text")
    asked = cut_lineage(bags(rest, ["ns", "key_id"], "key_text"))
    near = S.nearest(asked, cut_lineage(bags(stored, ["ns", "entry_id", "touch"], "key_text")))
    near = near.withColumn(
        "kind",
        F.when(F.col("sim") < threshold, "miss").when(F.col("sim") >= V.EXACT_SIMILARITY, "exact").otherwise("near"),
    ).withColumn("entry_id", F.when(F.col("kind") != "miss", F.col("entry_id")))
    hits = exact.select("ns", "key_id", "entry_id", F.lit(1.0).alias("sim"), F.lit("exact").alias("kind"))
    answers = entries.select("ns", "entry_id", "response")
    judged = hits.unionByName(near).join(answers, ["ns", "entry_id"], "left")
    out = requests.select("ns", "request_id", digest).join(judged, ["ns", "key_id"], "left")
    similarity = F.coalesce("sim", F.lit(0.0)).alias("similarity")
    kind = F.coalesce("kind", F.lit("miss")).alias("kind")
    return out.select("ns", "entry_id", "request_id", similarity, kind, "response")


# ---- replay -------------------------------------------------------------------------------------


def replay(requests: DataFrame, threshold: float = 0.95, miss_similarity: bool = True) -> DataFrame:
    """Outcome of every request of a log processed in ``seq`` order against an initially empty cache without eviction.

    ``requests``: ns, seq (unique per ns), key_text, response. A miss stores (key_text, response). Adds ``kind``
    (exact / near / miss), ``similarity``, ``entry_id`` (seq of the request that stored the entry) and ``answer``. A miss
    reports its best similarity to what was stored before it, or null if that is not asked for.
    """
    _check(threshold)
    rows = requests.withColumns({"base": F.col("ns"), "digest": _digest("key_text")})
    log = rows.select("base", "seq", "digest", F.col("response").alias("answer"))
    sure, chosen, kept_keys = _settled(log, requests, [threshold])
    out = _joined(rows, sure, chosen, [threshold]).drop("threshold")
    if miss_similarity:
        # a miss is the first request of a stored key
        ahead = S.best_before(kept_keys).withColumnRenamed("key_id", "seq")
        out = out.join(ahead, ["ns", "seq"], "left")
        missed = F.when(F.col("kind") == "miss", F.coalesce("best", F.lit(0.0)))
        out = out.withColumn("similarity", F.coalesce("similarity", missed)).drop("best")
    return out


def _check(threshold: float) -> None:
    if not 0.0 < threshold <= 1.0:
        raise ValueError(f"threshold must be in (0, 1], got {threshold}")


def _digest(text: str) -> Column:
    return F.unhex(F.sha2(text, 256))


def _settled(log: DataFrame, texts: DataFrame, thresholds: list[float]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Which entries answer the requests of a log at each threshold.

    ``log``: base (its namespace), seq, digest (of the key text), answer (what its entry would say). ``texts`` has every key
    text of the log. Returns (base, digest, sure), (base, seq, chosen) and the stored keys. ``sure`` and ``chosen`` have at
    most one (j, entry_id, sim, answer) for each threshold j: the only entry that may answer a prompt, which it does for the
    requests behind it, and the entry of a request that had a choice. So the log itself is never repeated by threshold.
    """
    digest = _digest("key_text").alias("digest")
    # a namespace at a threshold is called as in the log, behind the number of the threshold if there are several
    several = len(thresholds) > 1
    base = (F.substr("ns", F.instr("ns", ":") + 1) if several else F.col("ns")).alias("base")
    spaces = F.array(*[F.struct(F.lit(f"{j}:" if several else "").alias("j"), F.lit(float(t)).alias("threshold")) for j, t in enumerate(thresholds)])
    first = log.groupBy("base", "digest").agg(F.min("seq").alias("key_id")).withColumn("s", F.explode(spaces))
    first = cut_lineage(first.select("base", F.concat("s.j", "base").alias("ns"), "s.threshold", "digest", "key_id"))
    # a text that several namespaces ask is cut into tokens once
    counted = cut_lineage(bags(texts.select("key_text").distinct().select(digest, "key_text"), ["digest"], "key_text"))
    keys = cut_lineage(first.drop("base").join(counted, "digest").drop("digest"))
    names = first.select("ns", "key_id")
    # without tokens: never similar to anything
    without = names.join(keys.select("ns", "key_id"), ["ns", "key_id"], "left_anti")
    stored = cut_lineage(S.stored_keys(keys).unionByName(without))
    kept_keys = cut_lineage(keys.join(stored, ["ns", "key_id"], "left_semi"))
    others = keys.join(stored, ["ns", "key_id"], "left_anti")
    found = S.candidates(others, kept_keys.drop("threshold").withColumnRenamed("key_id", "entry_id"))
    own = stored.select("ns", "key_id", F.col("key_id").alias("entry_id"), F.lit(1.0).alias("sim"))
    found = cut_lineage(found.unionByName(own))

    # most keys have one entry that may answer them, so all requests behind it are settled with the key
    only = F.min("entry_id").alias("entry_id"), F.min("sim").alias("sim")
    judged = found.groupBy("ns", "key_id").agg(F.count("*").alias("n"), *only)
    judged = cut_lineage(judged.join(first.drop("threshold"), ["ns", "key_id"]))
    sure = judged.filter("n = 1").select("base", "ns", "digest", "entry_id", "sim")
    slim = log.join(judged.filter("n > 1").select("base", "ns", "digest", "key_id"), ["base", "digest"]).select("ns", "seq", "key_id")
    open_requests = slim.join(found, ["ns", "key_id"]).filter(F.col("entry_id") < F.col("seq"))
    best = F.max("sim").alias("best")
    sims = cut_lineage(open_requests.select("ns", "seq", "entry_id", "sim"))
    tied = sims.join(sims.groupBy("ns", "seq").agg(best), ["ns", "seq"]).filter("sim = best").drop("best")

    def sure_hits(entries: DataFrame) -> DataFrame:
        asked = log.join(sure.join(entries, ["ns", "entry_id"], "left_semi"), ["base", "digest"])
        return asked.filter(F.col("entry_id") < F.col("seq")).select("ns", "entry_id", F.col("seq").alias("hit"))

    chosen = _least_recent(cut_lineage(tied), sure_hits).select("*", base)
    answers = log.select("base", F.col("seq").alias("entry_id"), "answer")
    asked = stored.select(base, F.col("key_id").alias("entry_id")).distinct()
    answers = cut_lineage(answers.join(asked, ["base", "entry_id"]))
    j = (F.substring_index("ns", ":", 1).cast("int") if several else F.lit(0)).alias("j")
    entry = F.collect_list(F.struct(j, "entry_id", "sim", "answer"))  # at most one for a threshold
    sure = sure.join(answers, ["base", "entry_id"]).groupBy("base", "digest").agg(entry.alias("sure"))
    chosen = chosen.join(answers, ["base", "entry_id"]).groupBy("base", "seq").agg(entry.alias("chosen"))
    return sure, chosen, kept_keys


def _joined(rows: DataFrame, sure: DataFrame, chosen: DataFrame, thresholds: list[float]) -> DataFrame:
    """The requests, with ``base`` and ``digest``, once for each threshold, with the entry that ``_settled`` found."""
    out = rows.join(sure, ["base", "digest"], "left").join(chosen, ["base", "seq"], "left")

    def answer(j: int) -> Column:
        took = F.get(F.filter("chosen", lambda e: e["j"] == j), 0)
        only = F.get(F.filter("sure", lambda e: (e["j"] == j) & (e["entry_id"] < F.col("seq"))), 0)
        return F.struct(F.lit(float(thresholds[j])).alias("threshold"), F.coalesce(took, only).alias("e"))

    out = out.withColumn("_run", F.explode(F.array(*[answer(j) for j in range(len(thresholds))])))
    similarity = F.col("_run.e.sim")
    kind = F.when(similarity.isNull(), "miss").when(similarity >= V.EXACT_SIMILARITY, "exact").otherwise("near")
    found = {"entry_id": F.col("_run.e.entry_id"), "similarity": similarity, "answer": F.col("_run.e.answer"), "kind": kind}
    return out.withColumns({"threshold": F.col("_run.threshold")} | found).drop("_run", "sure", "chosen", "base", "digest")


_SLICE = 1 << 16  # requests per slice of an entry's timeline
#: Ties, and hits on their entries, of a namespace that one ordered walk settles; larger namespaces go on in rounds.
TIE_ROWS = 1 << 17


def _least_recent(tied: DataFrame, sure_hits: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """One entry per request: the least recently touched of its equally similar ones.

    A touch is the storing or an earlier hit. Requests without a tie are settled at once. A tie depends on earlier
    choices only, so a namespace with at most ``TIE_ROWS`` rows of ties and hits on their entries is walked in order; in a
    larger one choices are recomputed until they stop changing. ``sure_hits`` gives the (ns, entry_id, hit) of all other
    requests on some entries.
    """
    n = tied.groupBy("ns", "seq").agg(F.count("*").alias("n"))
    counted = tied.join(n, ["ns", "seq"])
    single = cut_lineage(counted.filter("n = 1").drop("n"))
    several = cut_lineage(counted.filter("n > 1").drop("n"))
    if several.isEmpty():
        return single
    # of the settled requests only those on an entry that takes part in a tie matter, and they never change
    involved = several.select("ns", "entry_id").distinct()
    settled = single.join(involved, ["ns", "entry_id"], "left_semi").select("ns", "entry_id", F.col("seq").alias("hit"))
    settled = cut_lineage(settled.unionByName(sure_hits(involved)))
    sizes = several.select("ns").unionByName(settled.select("ns")).groupBy("ns").agg(F.count("*").alias("n"))
    sizes = cut_lineage(sizes)
    small = F.col("n") <= TIE_ROWS
    total, large = sizes.agg(F.coalesce(F.sum(F.when(small, F.col("n"))), F.lit(0)), F.count_if(~small)).first()
    if not large:
        choice = _ties_walked(several, settled, total)
    else:
        few, many = sizes.filter(small).select("ns"), sizes.filter(~small).select("ns")
        choice = _ties_walked(*[x.join(few, "ns", "left_semi") for x in (several, settled)], total)
        choice = choice.unionByName(_ties_in_rounds(*[cut_lineage(x.join(many, "ns", "left_semi")) for x in (several, settled)]))
    return single.unionByName(several.join(choice, ["ns", "seq", "entry_id"]))


def _ties_walked(several: DataFrame, settled: DataFrame, total: int) -> DataFrame:
    """(ns, seq, entry_id) that the requests of each namespace choose when they come in order."""
    rows = several.select("ns", "seq", "entry_id", F.lit(False).alias("hit"))
    rows = rows.unionByName(settled.select("ns", F.col("hit").alias("seq"), "entry_id", F.lit(True).alias("hit")))
    group = F.pmod(F.xxhash64("ns"), F.lit(-(-total // max(TIE_ROWS, 1)) or 1)).alias("g")

    def walk(table: pa.Table) -> pa.Table:
        table = table.sort_by([(n, "ascending") for n in ("ns", "seq", "entry_id")])
        ns, seq, entry, hit = (table[n].to_pylist() for n in ("ns", "seq", "entry_id", "hit"))
        touched, chosen = {}, []
        for _, at in groupby(range(len(seq)), lambda i: (ns[i], seq[i])):
            best = min(at, key=lambda i: (touched.get((ns[i], entry[i]), entry[i]), entry[i]))
            touched[ns[best], entry[best]] = seq[best]
            if not hit[best]:
                chosen.append(best)
        return table.select(["ns", "seq", "entry_id"]).take(pa.array(chosen, pa.int64()))

    return rows.select("*", group).groupBy("g").applyInArrow(walk, "ns string, seq long, entry_id long")


def _ties_in_rounds(several: DataFrame, settled: DataFrame) -> DataFrame:
    """As ``_ties_walked``, with no namespace walked: a round settles the ties that no open one is ahead of."""
    choice = several.groupBy("ns", "seq").agg(F.min_by("entry_id", "entry_id").alias("entry_id"))
    while True:
        hits = settled.unionByName(
            choice.select("ns", "entry_id", F.col("seq").alias("hit"))
        )
        # last hit of each entry before the request: the latest one of the earlier slices, or of the own slice; an
        # entry with very many hits is handled slice by slice
        slice_ = F.floor(F.col("seq") / _SLICE)
        hits = hits.withColumnRenamed("hit", "seq").withColumn("s", slice_)
        per_slice = hits.groupBy("ns", "entry_id", "s").agg(F.max("seq").alias("m"))
        asked = several.select("ns", "entry_id", "seq").withColumn("s", slice_)
        all_slices = per_slice.unionByName(
            asked.select("ns", "entry_id", "s", F.lit(None).cast("long").alias("m")).distinct()
        ).groupBy("ns", "entry_id", "s").agg(F.max("m").alias("m"))
        earlier = Window.partitionBy("ns", "entry_id").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
        carried = all_slices.select("ns", "entry_id", "s", F.max("m").over(earlier).alias("carried"))
        marks = asked.select("ns", "entry_id", "s", "seq", F.lit(None).cast("long").alias("hit")).unionByName(
            hits.select("ns", "entry_id", "s", "seq", F.col("seq").alias("hit"))
        )
        line = Window.partitionBy("ns", "entry_id", "s").orderBy("seq").rangeBetween(Window.unboundedPreceding, -1)
        touched = marks.withColumn("last", F.max("hit").over(line)).filter("hit IS NULL")
        touched = touched.join(carried, ["ns", "entry_id", "s"])
        touched = touched.withColumn("last", F.coalesce(F.greatest("last", "carried", "entry_id"), F.col("entry_id")))
        new = cut_lineage(touched.groupBy("ns", "seq").agg(F.min_by("entry_id", "last").alias("entry_id")))
        changed = new.join(choice.withColumnRenamed("entry_id", "old"), ["ns", "seq"]).filter("entry_id <> old")
        stable = changed.isEmpty()
        choice = new
        if stable:
            break
    return choice


def stats(replayed: DataFrame, keys: list[str]) -> DataFrame:
    """Hit rate, exact and near hits, stores, evictions, tokens and USD saved, rounded to 6 digits.

    A hit saves the cost of the entry that answered: its key text in, its response out.
    """
    hit = F.col("kind") != "miss"
    t_in = F.when(hit, X.estimate_tokens(F.col("entry_text")))
    t_out = F.when(hit, X.estimate_tokens(F.col("answer")))
    usd = X.call_cost(t_in, t_out, F.lit(V.USD_PER_M_INPUT), F.lit(V.USD_PER_M_OUTPUT))
    return replayed.groupBy(*keys).agg(
        F.count("*").alias("lookups"),
        F.count_if(hit).alias("hits"),
        F.count_if(~hit).alias("misses"),
        F.count_if(~hit).alias("stores"),  # every miss is stored
        (F.count("evicted") if "evicted" in replayed.columns else F.lit(0).cast("long")).alias("evictions"),
        F.count_if(F.col("kind") == "exact").alias("exact_hits"),
        F.count_if(F.col("kind") == "near").alias("near_hits"),
        F.round(F.avg(hit.cast("int")), 6).alias("hit_rate"),
        F.coalesce(F.sum(t_in), F.lit(0)).alias("input_tokens_saved"),
        F.coalesce(F.sum(t_out), F.lit(0)).alias("output_tokens_saved"),
        F.round(F.coalesce(F.sum(usd), F.lit(0.0)), 6).alias("cost_saved_usd"),
    )


def report(replayed: DataFrame, keys: list[str]) -> DataFrame:
    """Savings against no cache and false hits (answer differs from the request's own truth)."""
    hit = F.col("kind") != "miss"
    differs = F.col("wrong") if "wrong" in replayed.columns else F.col("answer") != F.col("response")
    wrong = hit & differs
    saved = F.sum(F.when(hit, F.col("call_cost")).otherwise(0.0))
    rate = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return replayed.groupBy(*keys).agg(
        F.count("*").alias("lookups"),
        F.count_if(hit).alias("hits"),
        F.round(F.avg(hit.cast("int")), 6).alias("hit_rate"),
        *[
            F.count_if(hit & (F.col("request_kind") == k)).alias(f"hits_{k}")
            for k in ("cold", "exact_return", "paraphrase_return")
        ],
        F.round(F.sum("call_cost"), 6).alias("no_cache_cost_usd"),
        F.round(saved, 6).alias("cost_saved_usd"),
        F.round(rate(saved * 100, F.sum("call_cost")), 4).alias("cost_reduction_pct"),
        F.count_if(wrong).alias("false_hits"),
        F.round(rate(F.count_if(wrong), F.count_if(hit)), 6).alias("false_hit_rate"),
    )


def sweep(requests: DataFrame, thresholds: list[float], scopes: dict[str, Column], answers: bool = True) -> DataFrame:
    """Replays under every scope and threshold, tagged with both, without the similarity of misses. ``wrong``: the answer
    of a hit differs from the request's own response.

    One replay in all: scope and threshold are part of the namespace, so texts are cut into tokens once and every round
    serves all of them. Pairs are compared for each threshold apart, since the few that a threshold needs are not among
    those of a lower one: there other keys are stored. The log goes through the joins once for each scope, with digests
    for texts, and is repeated by threshold behind them. Without ``answers`` the text of an answer, which is the response
    of the request ``entry_id``, is not joined.
    """
    for t in thresholds:
        _check(t)
    spaces = [
        F.struct(F.lit(scope).alias("scope"), ns.cast("string").alias("ns"), F.concat(F.lit(f"{i}:"), ns.cast("string")).alias("base"))
        for i, (scope, ns) in enumerate(scopes.items())
    ]
    # digests once for all spaces
    rows = requests.withColumns({"digest": _digest("key_text"), "_told": _digest("response"), "_spaces": F.array(*spaces)})

    def spread(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("_space", F.explode("_spaces")).drop("_spaces").filter("_space.ns IS NOT NULL")
        return rows.withColumn("base", F.col("_space.base"))

    log = kept(rows.select("seq", "digest", F.col("_told").alias("answer"), "_spaces"), "log")
    sure, chosen, _ = _settled(spread(log).select("base", "seq", "digest", "answer"), requests, thresholds)
    runs = _joined(spread(rows), sure, chosen, thresholds)
    runs = runs.withColumn("wrong", F.col("answer") != F.col("_told"))
    names = [c for c in runs.columns if c not in ("_space", "_told", "ns", "threshold", "answer")]
    runs = runs.select("_space.scope", "threshold", "_space.ns", *names)
    if not answers:
        return runs
    said = spread(rows).select("_space.scope", "_space.ns", F.col("seq").alias("entry_id"), F.col("response").alias("answer"))
    return runs.join(said, ["scope", "ns", "entry_id"], "left")


def replay_lru(requests: DataFrame, threshold: float, max_entries: int) -> DataFrame:
    """Replay with at most ``max_entries`` entries per namespace, the least recently used one being evicted.

    Eviction makes each outcome depend on the whole sequence before it, so a namespace is walked in order. Its rows
    arrive sorted and are streamed: memory holds the entries of one namespace, never its requests. Use customer-scoped
    namespaces; ``replay`` is the form for large ones.
    """
    if not 0.0 < threshold <= 1.0:
        raise ValueError(f"threshold must be in (0, 1], got {threshold}")
    if max_entries <= 0:
        raise ValueError(f"max_entries must be positive, got {max_entries}")
    exact_at = V.EXACT_SIMILARITY
    vector = X.buckets(F.col("key_text"))
    rows = requests.select("ns", "seq", "key_text", "response", vector.alias("buckets"))
    ordered = rows.repartition("ns").sortWithinPartitions("ns", "seq")

    def walk(batches):
        import math
        from collections import Counter, OrderedDict

        import pandas as pd

        ns, lru, by_key = None, OrderedDict(), {}
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                if row.ns != ns:
                    ns, lru, by_key = row.ns, OrderedDict(), {}
                vec = Counter(row.buckets)
                norm = math.sqrt(sum(c * c for c in vec.values()))
                best, sim = by_key.get(row.key_text), 1.0
                if best is None:
                    sim = 0.0
                    for entry, (_, other, other_norm, _) in lru.items():
                        small, large = (vec, other) if len(vec) <= len(other) else (other, vec)
                        dot = sum(c * large.get(b, 0) for b, c in small.items())
                        s = dot / (norm * other_norm) if dot else 0.0
                        if s > sim:
                            best, sim = entry, s
                evicted = None
                if best is not None and sim >= threshold:
                    lru.move_to_end(best)
                    out.append((ns, row.seq, "exact" if sim >= exact_at else "near", sim, best, lru[best][3], evicted))
                    continue
                lru[row.seq] = (row.key_text, vec, norm, row.response)
                by_key[row.key_text] = row.seq
                if len(lru) > max_entries:
                    evicted, (old_key, *_) = lru.popitem(last=False)
                    by_key.pop(old_key, None)
                out.append((ns, row.seq, "miss", sim, None, None, evicted))
            frame = pd.DataFrame(out, columns=["ns", "seq", "kind", "similarity", "entry_id", "answer", "evicted"])
            yield frame.astype({"entry_id": "Int64", "evicted": "Int64"})

    return ordered.mapInPandas(
        walk, "ns string, seq long, kind string, similarity double, entry_id long, answer string, evicted long"
    )
