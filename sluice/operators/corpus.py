"""From page records to training splits: quality, near-duplicates, contamination, sampling and splits."""

from __future__ import annotations

import random
import re
from collections.abc import Callable, Iterator
from functools import reduce
from operator import add, or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.functions import near
from sluice.functions.text import fnv1a32, simhash, whole_document
from sluice.operators.lookup import checked_broadcast
from sluice.operators.rank import numbered

MIN_BODY_CHARS, MIN_META_TOKENS = 80, 6
# Phrases of parked, challenge and removed pages.
PARKED = ("domain is for sale", "buy this domain", "this domain is parked", "domain parking", "is for sale", "purchase this domain", "godaddy", "sedo", "hugedomains")
CHALLENGE = (
    "performing security verification",
    "this website uses a security service to protect",
    "verifying you are not a bot",
    "verify you are human by completing",
    "checking your browser before accessing",
    "enable javascript and cookies to continue",
    "needs to review the security of your connection",
    "sorry, you have been blocked",
    "ddos protection by cloudflare",
    "performance & security by cloudflare",
    "ray id:",
    "detected unusual traffic",
    "unusual traffic from your computer",
    "checks to see if it's really you",
    "press & hold to confirm",
    "access to this page has been denied",
    "please verify you are a human",
    "your request has been blocked",
    "please enable javascript to continue",
)
REMOVED = (
    "blog has been removed",
    "requested url was not found",
    "404 not found",
    "page not found",
    "this account has been suspended",
    "account has been suspended",
    "default webpage generated",
    "this is the default web page",
    "welcome to nginx",
    "directory listing for",
)
# Words, and phrases, that tell a category, in order of precedence.
SIGNALS: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    "gambling": (
        ("casino", "casinos", "slots", "betting", "sportsbook", "poker", "roulette", "baccarat", "jackpot", "togel", "bandar", "blackjack", "bookmaker", "wager", "gamble", "gambling", "bookie"),
        ("no deposit", "free spins", "live casino", "online casino", "sports betting", "welcome bonus", "deposit bonus"),
    ),
    "adult": (
        ("porn", "xxx", "nude", "naked", "camgirl", "hentai", "milf", "anal", "blowjob", "creampie", "cumshot", "redtube", "xvideos", "pornhub"),
        ("adult content", "porn videos", "live sex", "sex cams", "xxx videos", "free porn", "sex videos"),
    ),
    "proxy-bypass": (
        ("unblock", "glype", "phproxy", "cgiproxy"),
        ("web proxy", "free proxy", "online proxy", "proxy site", "hide your ip", "browse anonymously", "anonymous browsing", "unblock websites", "unblock any site", "enter a url", "enter url", "bypass filters"),
    ),
    "games": ((), ("free online games", "play free games", "play games online", "browser games", "io games", "multiplayer games", "free flash games")),
}
#: Bits by which near-duplicates may differ; no more than 4.
NEAR_BITS = 4
#: Rows of a group that are decided first, and how many times as many are after each step.
FIRST, GROWTH = 1 << 14, 8
#: Ranks of a group that a tile spans, and tasks that pairs of tiles of large groups are dealt to; others to as many as a shuffle has.
TILE, MOST_TASKS = 1 << 16, 1000


def _any_of(text: Column, phrases: tuple[str, ...]) -> Column:
    """Whether a text holds a phrase; a phrase that holds another one need not be looked for."""
    least = [p for p in phrases if not any(q != p and q in p for q in phrases)]
    return reduce(or_, [text.contains(p) for p in least])


def is_usable(title: Column, meta: Column, text: Column) -> Column:
    """Enough body or enough title and description, and no phrase of a parked, challenge or removed page."""
    t, m, b = (F.lower(F.coalesce(x, F.lit(""))) for x in (title, meta, text))
    solid = lambda x: F.length(F.regexp_replace(x, r"(?U)\s+", ""))
    # Most texts have enough in their first characters; the whole of the others is counted.
    thin = F.when(solid(F.substring(b, 1, 4 * MIN_BODY_CHARS)) >= MIN_BODY_CHARS, False).otherwise(solid(b) < MIN_BODY_CHARS)
    tokens = F.size(F.filter(F.split(F.concat(t, F.lit(" "), m), r"(?U)\s+"), lambda x: x != ""))
    blob = F.concat(t, F.lit(" "), m, F.lit(" "), b)
    return ~(thin & (tokens < MIN_META_TOKENS)) & ~_any_of(blob, PARKED + CHALLENGE + REMOVED)


def contamination(text: Column, signals: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = SIGNALS) -> Column:
    """The category with the most distinct words and phrases in the text, if more than one; ties go to the earlier."""

    def counts(low: Column) -> Column:
        # A word's borders are only looked for where its letters are.
        word = lambda w: F.when(low.contains(w), low.rlike(rf"\b{re.escape(w)}\b")).otherwise(False)
        each = [[*map(word, words), *map(low.contains, phrases)] for words, phrases in signals.values()]
        return F.array(*[reduce(add, [x.cast("int") for x in found], F.lit(0)) for found in each])

    def best(n: Column) -> Column:
        named = F.array_position(n, F.array_max(n))
        return F.when(F.array_max(n) > 1, F.get(F.array(*map(F.lit, signals)), (named - 1).cast("int")))

    # Lambdas, so that the text is folded, and its signals counted, once.
    folded = F.transform(F.array(F.lower(F.coalesce(text, F.lit("")))), counts)
    return F.get(F.transform(folded, best), F.lit(0))


def with_contamination(df: DataFrame, clean: str, label: str = "label", text: Column | None = None, signals=SIGNALS) -> DataFrame:
    """`df` with the column contamination; only clean rows are looked at.  Kept rows have null there."""
    blob = whole_document(F.col("title"), F.col("meta"), F.col("text")) if text is None else text
    return df.withColumn("contamination", F.when(F.col(label) == clean, contamination(blob, signals)))


def _tile(rank: str) -> Column:
    return F.floor(F.col(rank) / F.lit(TILE)).cast("long")


def _tile_pairs(left: DataFrame, right: DataFrame, find: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], Iterator[list[np.ndarray]]], schema: str, tiles: int) -> DataFrame:
    """What `find` (numbers and hashes of the left, then of the right) gives of every tile of `left` with every tile of `right` that its rows name; both are (g, tile, others, n, h).

    A pair of tiles is the most that a task holds.  It is brought together by both tiles, so no group, nor key of one, is in a task alone.
    """

    def run(both: pa.Table) -> pa.Table:
        n, h, own = (both.column(c).to_numpy() for c in ("n", "h", "own"))
        h = h.view(np.uint64)
        found = [*find(n[own], h[own], n[~own], h[~own])]
        names = [x.split()[0] for x in schema.split(", ")]
        columns = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * len(names)
        return pa.table([pa.array(c) for c in columns], names)

    each = lambda df, own: df.select("g", "n", "h", "tile", F.explode("others").alias("other"), F.lit(own).alias("own"))
    every = each(left, True).withColumnsRenamed({"tile": "a", "other": "b"}).unionByName(each(right, False).withColumnsRenamed({"tile": "b", "other": "a"}))
    tasks = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MOST_TASKS, tiles))
    return every.repartition(tasks, "g", "a", "b").groupBy("g", "a", "b").applyInArrow(run, schema)


def near_kept(rows: DataFrame, kept: DataFrame, low: int, high: int) -> DataFrame:
    """(n) of `rows`, of ranks `low` to `high` in their groups, whose hashes are within NEAR_BITS of one of `kept`, of ranks below `low`; both are (g, n, h, rank, size)."""
    first, last = F.lit(low // TILE), F.floor((F.least(F.col("size"), F.lit(high)) - 1) / TILE).cast("long")
    left = rows.withColumns({"tile": _tile("rank"), "others": F.sequence(F.lit(0).cast("long"), F.lit((low - 1) // TILE).cast("long"))})
    right = kept.where(F.col("size") > low).withColumns({"tile": _tile("rank"), "others": F.sequence(first.cast("long"), last)})

    def find(n, h, _, y):
        yield [n[near.covered(h, y, NEAR_BITS)]]

    return _tile_pairs(left, right, find, "n long", 4 * ((low - 1) // TILE + 1) * ((high - 1) // TILE - low // TILE + 1)).distinct()


def near_duplicate_edges(rows: DataFrame, low: int, high: int) -> DataFrame:
    """(a, b) of rows (g, n, h, rank, size), of ranks `low` to `high` in their groups, a before b, whose hashes differ in up to NEAR_BITS bits."""
    first, last = F.lit(low // TILE).cast("long"), F.floor((F.least(F.col("size"), F.lit(high)) - 1) / TILE).cast("long")
    left = rows.withColumn("tile", _tile("rank")).withColumn("others", F.sequence(F.col("tile"), last))
    right = rows.withColumn("tile", _tile("rank")).withColumn("others", F.sequence(first, F.col("tile")))

    def find(n, x, m, y):
        for i, j in near.pairs(x, y, NEAR_BITS):
            before = n[i] < m[j]
            yield [n[i[before]], m[j[before]]]

    return _tile_pairs(left, right, find, "a long, b long", 4 * ((high - 1) // TILE - low // TILE + 1) ** 2)


def _first_of_near(rows: DataFrame, edges: DataFrame, store) -> DataFrame:
    """`rows` that a pass in order of n keeps.

    In rounds: a row whose earlier neighbours are all dropped is kept, one with a kept
    earlier neighbour is dropped, until every row is decided.
    """
    late = edges.select(F.col("b").alias("n")).distinct().withColumn("late", F.lit(True))
    state = store(rows.select("n").join(late, "n", "left").select("n", F.when(F.col("late"), F.lit(None).cast("boolean")).otherwise(F.lit(True)).alias("kept")))
    while state.where("kept is null").limit(1).count():
        before = edges.join(state.select(F.col("n").alias("a"), "kept"), "a").groupBy(F.col("b").alias("n")).agg(F.max(F.coalesce("kept", F.lit(False))).alias("near_kept"), F.max(F.col("kept").isNull()).alias("open"))
        joined = state.join(before, "n", "left")
        new = F.when(F.col("kept").isNotNull(), F.col("kept")).when(F.col("near_kept"), F.lit(False)).when(~F.col("open"), F.lit(True))
        state = store(joined.select("n", new.alias("kept")))
    return rows.join(state.where("kept").select("n"), "n", "left_semi")


def keep_first_of_near(df: DataFrame, group_col: str, seq_col: str, hash_col: str, store=None) -> DataFrame:
    """The rows that a pass in order of `seq_col` keeps: those not near a row kept before, within a group.

    Rows with equal hashes come down to the first.  The first FIRST of each group are decided
    among themselves, then GROWTH times as many, and so on: rows near one that is kept
    already leave, and only those left are compared with each other.  So dense places
    bring few pairs however many rows they have.
    """
    from sluice.plans.session import stored

    store = store or stored
    key = F.coalesce(F.col(group_col).cast("string"), F.lit("\x00"))
    first = df.groupBy(key.alias("g"), F.col(hash_col).alias("h")).agg(F.min(seq_col).alias("seq"))
    first = store(numbered(first, F.col("g"), F.col("seq")))
    groups = store(first.groupBy("g").agg(F.min("n").alias("__first"), F.count("*").alias("size")))
    ranked = first.join(checked_broadcast(groups), "g").select("g", "seq", "h", "n", "size", (F.col("n") - F.col("__first")).alias("rank"))
    most = groups.agg(F.max("size")).first()[0] or 0
    low, high, kept = 0, FIRST, None
    while kept is None or low < most:
        rows = ranked.where((F.col("rank") >= low) & (F.col("rank") < high))
        if kept is not None:
            rows = rows.join(near_kept(rows, kept, low, min(high, most)), "n", "left_anti").select(*ranked.columns)
        rows = store(rows)
        new = store(_first_of_near(rows, store(near_duplicate_edges(rows, low, max(low + 1, min(high, most)))), store).select(*ranked.columns))
        kept = new if kept is None else kept.unionByName(new)
        low, high = high, high * GROWTH
    return df.join(kept.select(F.col("seq").alias(seq_col)), seq_col, "left_semi")


def without_near_duplicates(df: DataFrame, seq_col: str, group_col: str, text_col: str) -> DataFrame:
    """`df` without near-duplicates within a group, by the 64-bit fingerprint of the text."""
    from sluice.plans.session import stored

    # Texts stay where they are: only numbers, groups and fingerprints are stored, and the kept numbers go back to the texts.
    hashed = stored(simhash(df, seq_col, text_col, "simhash", keep=(group_col,)))
    return df.join(keep_first_of_near(hashed, group_col, seq_col, "simhash").select(seq_col), seq_col, "left_semi")


def hash_order(seed: int, *columns: str) -> list[Column]:
    """A fixed order as good as random, the same in every engine that has FNV."""
    return [fnv1a32(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns])), *[F.col(c) for c in columns]]


def split_by_key(df: DataFrame, key: str, ratios: tuple[float, float, float], seed: int = 0) -> DataFrame:
    """`df` with the column split: all rows of a key are in train, val or test.

    Keys are ordered by hash and cut at whole numbers of keys; only keys are ranked.
    """
    ranked = numbered(df.select(key).distinct(), *hash_order(seed, key))
    total = ranked.count()
    a, b = int(total * ratios[0]), int(total * ratios[1])
    named = ranked.select(key, F.when(F.col("n") < a, "train").when(F.col("n") < a + b, "val").otherwise("test").alias("split"))
    return df.join(named, key)


def split_like_shuffle(keys: list[str], ratios: tuple[float, float, float], seed: int = 0) -> dict[str, str]:
    """The split of a seeded Mersenne shuffle of sorted distinct keys, on the driver; for parity on small key sets."""
    order = sorted(set(keys))
    random.Random(seed).shuffle(order)
    a, b = int(len(order) * ratios[0]), int(len(order) * ratios[1])
    return {k: "train" if i < a else "val" if i < a + b else "test" for i, k in enumerate(order)}


def sample_per_label(df: DataFrame, label: str, key: str, most: int, seed: int = 0) -> DataFrame:
    """At most `most` rows of each label, in hash order."""
    return df.withColumn("n", F.row_number().over(Window.partitionBy(label).orderBy(*hash_order(seed, key)))).where(F.col("n") <= most).drop("n")


def pools(rows: DataFrame, ranks: DataFrame, *, popular_first: tuple[str, ...] = (), deny: tuple[str, ...] = (), forced: DataFrame | None = None, seed: int = 0) -> DataFrame:
    """(label, domain, pos): the order in which a label's domains are taken up.

    Forced domains of a label come first and leave all other pools; then, for labels in
    `popular_first`, ranked domains by rank; then the rest in hash order.
    """
    kept = rows
    for token in deny:
        kept = kept.where(~F.col("domain").contains(token))
    kept = kept.join(ranks.select("domain", "rank"), "domain", "left").withColumn("turn", F.when(F.col("label").isin(*popular_first) & F.col("rank").isNotNull(), 1).otherwise(2))
    kept = kept.select("label", "domain", "turn", F.when(F.col("turn") == 1, F.col("rank").cast("long")).alias("at"))
    if forced is not None:
        own = forced.groupBy("label", "domain").agg(F.min("seq").cast("long").alias("at")).select("label", "domain", F.lit(0).alias("turn"), "at")
        labels = rows.select("label").distinct()
        kept = kept.join(forced.select("domain").distinct(), "domain", "left_anti").unionByName(own.join(labels, "label", "left_semi"))
    # numbered over all labels, and from the first of each: a label may hold most rows
    every = numbered(kept, F.col("label"), F.col("turn"), F.col("at"), *hash_order(seed, "domain"))
    first = every.groupBy("label").agg(F.min("n").alias("first"))
    return every.join(checked_broadcast(first), "label").select("label", "domain", (F.col("n") - F.col("first") + 1).cast("int").alias("pos"))


def remaining(pool: DataFrame, *taken: DataFrame, key: str = "domain") -> DataFrame:
    """`pool` without the keys of the other tables; repeated rows stay."""
    for t in taken:
        pool = pool.join(t.select(key).distinct(), key, "left_anti")
    return pool


def interior_links(links: DataFrame, most: int, seed: int = 0) -> DataFrame:
    """(page_id, link) of up to `most` distinct links within a page's own site, its root left out.

    `links` has page_id, link, link_site, page_site and seq.  A page with no more keeps all,
    others a hash-ordered choice.
    """
    from sluice.functions.urls import pathname, query_string

    inner = links.where((F.col("link_site") == F.col("page_site")) & (F.col("page_site") != ""))
    inner = inner.where(~((F.regexp_replace(pathname("link"), "^/+|/+$", "") == "") & (query_string("link") == "")))
    one = inner.groupBy("page_id", "link").agg(F.min("seq").alias("seq"))
    return one.withColumn("n", F.row_number().over(Window.partitionBy("page_id").orderBy(*hash_order(seed, "link")))).where(F.col("n") <= most).select("page_id", "link", "seq")


def pick_anchor(candidates: DataFrame) -> DataFrame:
    """(provider, domain): one registrable domain per provider.

    `candidates` has provider, etld1 and seq.  A domain whose first label, of four letters
    or more, goes with the provider's name comes before one with a throw-away top-level
    domain, and that before the first; shared platforms do not count.
    """
    from sluice.functions.urls import PLATFORMS, PROXY_TLDS

    name = F.regexp_replace(F.lower("provider"), "[^a-z0-9]", "")
    label = F.substring_index("etld1", ".", 1)
    branded = (F.length(label) >= 4) & (name.contains(label) | label.contains(name) | (F.substring(name, 1, 5) == F.substring(label, 1, 5)))
    turn = F.when(branded, 0).when(F.substring_index("etld1", ".", -1).isin(*PROXY_TLDS), 1).otherwise(2)
    kept = candidates.where((F.col("etld1") != "") & ~F.col("etld1").isin(*PLATFORMS))
    return kept.groupBy("provider").agg(F.min_by("etld1", F.struct(turn.alias("turn"), F.col("seq"))).alias("domain"))
