"""Self-join of documents on the Jaccard similarity of their word shingles, by token-combination prefixes.

Exact for every pair (up to 64-bit hashes of shingles and sets); no candidate is capped. The steps:

1. Equal sets are one node. Of every node, the tokens (shingle hashes) under a bound are counted over the corpus. A set
   of n tokens can miss at most ``slack(n)`` of them in a similar set, so a node with more tokens of its own than that
   has no partner and is done. The bounds fall with n in such a way that a node's tokens are always seen in a partner.
2. The sets of the nodes that are left are written, and all their tokens are counted among them.
3. Each node takes its prefix, rarest tokens first: single tokens as long as they are rare, combinations of two tokens
   of one group after that. The prefix is long enough that a similar set must share one of these signatures.
4. Signatures join nodes. All nodes of a signature are first verified against the one with the fewest own tokens; only
   nodes that are still in different components, and whose sizes and own tokens leave room for enough shared ones, are
   then verified with each other: they meet by signature and class of size, where the classes a node goes to are those its
   own tokens leave room for, and nodes of a signature's largest component only meet those of others. Components take the
   links.
"""

from __future__ import annotations

from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medialedger.identity.components import connected_components
from medialedger.llm.ledger import Chunk, distinct_places, recurring
from medialedger.llm.store import discard, has_member, materialize, member_bits, small
from medialedger.llm.wordscan import Words, mix, scan_words, slices, spans_hash

_U = np.uint64
_ROWS = "doc_id bigint, text_key bigint, node bigint, n_shingles bigint, open boolean"
#: Sizes of one class differ by this factor at most.
_CLASS = 1.05
_SETS = "node bigint, tokens binary"
_SIGNATURES = "sig bigint, node bigint, own int, alone int, n int, short boolean"


def shingle_sets(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every distinct shingle of k words, sorted by row and hash; a shorter text is one shingle."""
    first, sizes = words.first, words.per_row
    short = np.flatnonzero((sizes > 0) & (sizes < k))
    n = max(0, len(words.hash) - k + 1)
    at = np.flatnonzero(words.row[:n] == words.row[k - 1 :]) if n else np.zeros(0, np.int64)
    starts = np.concatenate([at, first[short]])
    ends = np.concatenate([at + k, first[short] + sizes[short]])
    rows = np.concatenate([words.row[at], short])
    hashes = spans_hash(words.hash, starts, ends, "gram")
    order = np.lexsort((hashes, rows))
    rows, hashes = rows[order], hashes[order]
    new = np.ones(len(rows), dtype=bool)
    new[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
    return rows[new], hashes[new]


def set_nodes(rows: np.ndarray, hashes: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(set size, hash of the whole set as int64) of each row; of no meaning for an empty set."""
    sizes = np.bincount(rows, minlength=n_rows)
    node = np.zeros(n_rows, dtype=np.uint64)
    full = np.flatnonzero(sizes)
    if len(full):
        ends = np.cumsum(sizes)
        node[full] = np.add.reduceat(mix(hashes + _U(0x2545F4914F6CDD1D)), (ends - sizes)[full])
    return sizes, mix(node + sizes.astype(np.uint64) * _U(0x9E3779B97F4A7C15)).view(np.int64)


def _below(hashes: np.ndarray, share: np.ndarray) -> np.ndarray:
    return (hashes >> _U(11)).astype(np.float64) < share * float(1 << 53)


def _combined(tokens: np.ndarray, groups: np.ndarray, salt: int) -> np.ndarray:
    """A hash of every pair of tokens of one group."""
    order = np.lexsort((tokens, groups))
    tokens, groups = tokens[order], groups[order]
    out = []
    for lag in range(1, len(tokens)):
        same = groups[lag:] == groups[:-lag]
        if not same.any():
            break
        out.append(mix(mix(tokens[:-lag][same]) + _U(3) * tokens[lag:][same] + _U(salt)))
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)


def prefix_signatures(tokens: np.ndarray, counts: np.ndarray, slack: int, rare: int, ratio: tuple[int, int]) -> tuple[np.ndarray, int, int]:
    """Signatures of one set, how many of them are single tokens (they come first), and how many tokens no other set has.

    ``counts`` are corpus counts. Up to ``slack`` tokens may be missing in a partner. Rare tokens stand for themselves;
    of the frequent ones, groups of m tokens account for m - 1 misses unless two of them are shared. Sets of different
    sizes need the same groups, so those follow the size class, and a set near the next class is also indexed there.
    """
    own = counts == 1
    n, n_own = len(tokens), int(own.sum())
    need = slack + 1 - n_own
    if need <= 0 or (n + 1) * ratio[0] > n * ratio[1]:  # too small for a different partner, larger or smaller
        return np.zeros(0, dtype=np.uint64), 0, n_own
    tokens, counts = tokens[~own], counts[~own]
    order = np.lexsort((tokens, counts))
    tokens, counts = tokens[order], counts[order]
    n_rare = int((counts <= rare).sum())
    out = [mix(tokens[: min(need, n_rare)])]
    need -= min(need, n_rare)
    if need:
        frequent = tokens[n_rare:]
        size_class = n.bit_length() - 1
        classes = [size_class]
        if n * ratio[1] >= (1 << (size_class + 1)) * ratio[0]:
            classes.append(size_class + 1)
        for c in classes:
            groups = mix(frequent + _U(0x632BE59BD9B4E019)) % _U(max(1, (1 << c) // 8))
            order = np.argsort(groups, kind="stable")
            extra = np.zeros(len(frequent), dtype=bool)
            extra[order[1:]] = groups[order[1:]] == groups[order[:-1]]
            length = int(np.searchsorted(np.cumsum(extra), need)) + 1
            out.append(_combined(frequent[:length], groups[:length], c + 1))
    return np.concatenate(out), len(out[0]), n_own


class JaccardJoin:
    """Links of documents whose shingle sets have a Jaccard similarity of ``numerator / 100`` or more."""

    def __init__(self, shingle: int = 5, numerator: int = 80, rare: int = 16, member_bits_log2: int = 23):
        self.k, self.num, self.rare, self.log2_bits = shingle, numerator, rare, member_bits_log2

    def slack(self, n: np.ndarray | int) -> np.ndarray | int:
        """How many of n tokens a similar set may lack: n - ceil(n * num / 100)."""
        return n * (100 - self.num) // 100

    def _share(self, n: np.ndarray) -> np.ndarray:
        return np.minimum(1.0, 1.4 * (1 - self.num / 100) + 16 / np.maximum(n, 1e-9))

    def documents(self, docs: DataFrame) -> DataFrame:
        """Step 1: doc_id, text_key (a hash of the text), node (null for an empty set), n_shingles, and whether the node may
        have a partner.

        Copies within one chunk carry ``open`` only once.
        """
        k, num, slack, share = self.k, self.num, self.slack, self._share

        def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[Chunk]:
            for part in slices(batches, "text"):
                rows, hashes = shingle_sets(scan_words(part.column("text"), fold=True), k)
                sizes, nodes = set_nodes(rows, hashes, len(part))
                full = np.flatnonzero(sizes)
                first = np.zeros(len(part), dtype=bool)
                first[full[np.unique(nodes[full], return_index=True)[1]]] = True
                # A partner has num / 100 to 100 / num times as many tokens: send what the smallest of them looks at.
                sent = first[rows] & _below(hashes, share(sizes * num / 100)[rows])
                looked = sent & _below(hashes, share(sizes.astype(float))[rows])
                rows_sent, hashes_sent = rows[sent], hashes[sent]
                places, again = distinct_places(hashes_sent)
                payload = pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"), part.column("text_key"), pa.array(nodes, mask=sizes == 0), pa.array(sizes), pa.array(first),
                        pa.array(np.bincount(rows_sent, minlength=len(part))),
                        pa.array(np.bincount(rows[looked], minlength=len(part))),
                    ],
                    names=["doc_id", "text_key", "node", "n", "first", "sent", "looked"],
                )
                yield Chunk(hashes_sent[places], mix(hashes_sent[places] ^ _U(0x94D049BB133111EB)), places, payload, known=again)

        def finish(payload: pa.RecordBatch, places: np.ndarray, _: np.ndarray) -> pa.RecordBatch:
            n, sent, looked = (payload.column(c).to_numpy() for c in ("n", "sent", "looked"))
            ends = np.cumsum(sent)
            shared = np.zeros(int(ends[-1]) if len(ends) else 0, dtype=bool)
            shared[places] = True
            at = np.flatnonzero(shared)
            row = np.searchsorted(ends, at, "right")
            seen = at - (ends - sent)[row] < looked[row]  # a row's tokens rise, so those looked at come first
            hits = np.bincount(row[seen], minlength=len(n))
            is_open = payload.column("first").to_numpy(zero_copy_only=False) & (looked - hits <= slack(n))
            return pa.RecordBatch.from_arrays(
                [*(payload.column(c) for c in ("doc_id", "text_key", "node", "n")), pa.array(is_open)],
                names=["doc_id", "text_key", "node", "n_shingles", "open"],
            )

        text = F.col("text").cast("string")
        rows = docs.select(F.col("doc_id").cast("bigint"), text.alias("text"), F.xxhash64(text).alias("text_key"))
        return recurring(rows, chunks, finish, _ROWS)

    def sets(self, docs: DataFrame, nodes: DataFrame) -> DataFrame:
        """Step 2: the sorted tokens of the given distinct nodes, read from the texts again."""
        k = self.k
        bits = member_bits(nodes, F.col("node"), self.log2_bits)

        def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sent: set[int] = set()  # of bounded size: it saves shuffling copies, which are dropped below in any case
            for part in slices(batches, "text"):
                rows, hashes = shingle_sets(scan_words(part.column("text"), fold=True), k)
                sizes, ids = set_nodes(rows, hashes, len(part))
                ends = np.cumsum(sizes)
                if len(sent) > 1 << 16:
                    sent.clear()
                out: tuple[list, list] = ([], [])
                for i in np.flatnonzero((sizes > 0) & has_member(bits, ids)):
                    if int(ids[i]) not in sent:
                        sent.add(int(ids[i]))
                        out[0].append(int(ids[i]))
                        out[1].append(hashes[ends[i] - sizes[i] : ends[i]].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary())], names=["node", "tokens"])

        found = docs.select(F.col("text").cast("string")).mapInArrow(tokens, _SETS)
        return found.dropDuplicates(["node"]).join(nodes, "node", "left_semi")

    def signatures(self, sets: DataFrame) -> DataFrame:
        """Step 3: (sig, node, own, alone, n, short) for each signature of each node's prefix.

        own counts the tokens that no other set has, alone those that a set met in this signature cannot share.
        In a pair, the set with fewer tokens can miss at most n * (100 - num) / (100 + num) of them; ``short`` marks the
        signatures of the prefix that is long enough for that part. A pair meets in a short one of its smaller set.
        """
        num, slack, rare, ratio = self.num, self.slack, self.rare, (self.num, 100)

        def part_tokens(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
            blobs = part.column("tokens").to_pylist()
            return np.frombuffer(b"".join(blobs), dtype=np.uint64), np.array([len(b) // 8 for b in blobs], dtype=np.int64)

        def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[Chunk]:
            for batch in batches:
                ends = np.cumsum([len(b) for b in batch.column("tokens").to_pylist()])
                at = 0
                while at < len(batch):
                    end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (2 << 20), "right")))
                    part = batch.slice(at, end - at)
                    at = end
                    tokens, _ = part_tokens(part)
                    distinct, counts = np.unique(tokens, return_counts=True)
                    yield Chunk(distinct, mix(distinct ^ _U(0x94D049BB133111EB)), np.arange(len(distinct)), part, counts=counts)

        def finish(payload: pa.RecordBatch, places: np.ndarray, counts: np.ndarray) -> pa.Table:
            tokens, sizes = part_tokens(payload)
            distinct, inverse = np.unique(tokens, return_inverse=True)
            total = np.ones(len(distinct), dtype=np.int64)
            total[places[: len(counts)]] = counts
            total = total[inverse]
            ends = np.cumsum(sizes)
            sigs, nodes, owns, alones, ns, shorts = [], [], [], [], [], []
            for node, end, n in zip(payload.column("node").to_pylist(), ends, sizes, strict=True):
                mine = tokens[end - n : end], total[end - n : end]
                sig, singles, own = prefix_signatures(*mine, int(slack(int(n))), rare, ratio)
                singles, combined = np.unique(sig[:singles]), np.unique(sig[singles:])
                sigs.append(np.concatenate([singles, combined]))
                size = len(sigs[-1])
                # With combinations, all rare tokens are signatures: a pair that meets in a combination only shares none.
                alones.append(np.repeat([own, int((mine[1] <= rare).sum())], [len(singles), len(combined)]))
                shorts.append(np.isin(sigs[-1], prefix_signatures(*mine, int(n) * (100 - num) // (100 + num), rare, ratio)[0]))
                nodes.append(np.full(size, node))
                owns.append(np.full(size, own))
                ns.append(np.full(size, n))
            cat = lambda x, t: pa.array(np.concatenate(x).astype(t) if x else np.zeros(0, t))
            sig = pa.array(np.concatenate(sigs).view(np.int64) if sigs else np.zeros(0, np.int64))
            return pa.table([sig, cat(nodes, np.int64), cat(owns, np.int32), cat(alones, np.int32), cat(ns, np.int32), cat(shorts, bool)], names=["sig", "node", "own", "alone", "n", "short"])

        return recurring(sets, chunks, finish, _SIGNATURES, with_counts=True)

    def verify(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """The pairs (a, b) whose sets are similar enough, by their whole sets."""
        num = self.num

        def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = []
                for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                    p, q = np.frombuffer(x.as_buffer(), dtype=np.uint64), np.frombuffer(y.as_buffer(), dtype=np.uint64)
                    both = np.concatenate([p, q])
                    both.sort()
                    common = int((both[1:] == both[:-1]).sum())
                    keep.append(100 * common >= num * (len(both) - common))
                yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

        x = sets.select(F.col("node").alias("a"), F.col("tokens").alias("x"))
        y = sets.select(F.col("node").alias("b"), F.col("tokens").alias("y"))
        return pairs.select("a", "b").join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(similar, "a bigint, b bigint")

    def links(self, sets: DataFrame) -> DataFrame:
        """Steps 3 and 4: links (a, b) between different nodes that give the right components."""
        sigs = materialize(self.signatures(sets), "jaccard-signatures")
        centre = (
            sigs.groupBy("sig")
            .agg(F.count("*").alias("size"), F.min(F.struct("own", "node")).alias("first"))
            .where("size > 1")
            .select("sig", F.col("first.node").alias("centre"))
        )
        ends = lambda p, q: (F.least(p, q).alias("a"), F.greatest(p, q).alias("b"))
        star = materialize(
            sigs.join(centre, "sig").where(F.col("node") != F.col("centre")).select(*ends("node", "centre")).distinct(), "jaccard-star"
        )
        found = materialize(self.verify(star, sets), "jaccard-links")
        roots = self.roots(found)
        labelled = sigs.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        by_root = labelled.groupBy("sig", "root").agg(F.count("*").alias("size"))
        split = by_root.groupBy("sig").agg(F.count("*").alias("roots"), F.max(F.struct("size", "root")).alias("top")).where("roots > 1")
        largest = F.col("root") == F.col("top.root")
        apart = materialize(labelled.join(split, "sig").select("sig", "node", "root", "n", "alone", "short", largest.alias("largest")), "jaccard-apart")
        rest = materialize(self.apart_pairs(apart).select(*ends("p_node", "q_node")).distinct().join(star, ["a", "b"], "left_anti"), "jaccard-rest")
        more = materialize(self.verify(rest, sets), "jaccard-links")
        discard(sigs, star, apart, rest)
        return found.unionByName(more)

    def apart_pairs(self, apart: DataFrame) -> DataFrame:
        """Pairs (p_node, q_node) of different components that meet in a signature and may share enough tokens.

        Two sets of n and m >= n tokens are similar only if m <= c * (100 + num) / num - n, where c counts the tokens that the
        first may share at all; so it goes to the classes of those sizes, mostly to none where own tokens use up the slack.
        """
        num = self.num
        size_class = lambda n: F.floor(F.log(n.cast("double")) / F.lit(float(np.log(_CLASS))))
        most = F.floor(((F.col("n") - F.col("alone")) * (100 + num) - F.col("n") * num) / num)
        sides = {x: [F.col(c).alias(f"{x}_{c}") for c in ("node", "root", "n", "alone")] for x in "pq"}
        p = apart.where(F.col("short") & (most >= F.col("n")))
        p = p.select("sig", *sides["p"], "largest", F.explode(F.sequence(size_class(F.col("n")), size_class(most))).alias("class"))
        q = apart.select("sig", *sides["q"], F.col("largest").alias("q_largest"), size_class(F.col("n")).alias("class"))
        of_others = p.where("NOT largest").join(q, ["sig", "class"])
        of_largest = p.where("largest").join(q.where("NOT q_largest"), ["sig", "class"])
        ordered = (F.col("p_n") < F.col("q_n")) | ((F.col("p_n") == F.col("q_n")) & (F.col("p_node") != F.col("q_node")))
        common = F.least(F.col("p_n") - F.col("p_alone"), F.col("q_n") - F.col("q_alone"))
        fits = common * 100 >= (F.col("p_n") + F.col("q_n") - common) * num
        return of_others.unionByName(of_largest).where((F.col("p_root") != F.col("q_root")) & ordered & fits)

    def roots(self, links: DataFrame) -> DataFrame:
        return connected_components(links, "a", "b", lambda df: materialize(df, "jaccard-components"), discard)

    def components(self, docs: DataFrame) -> DataFrame:
        """doc_id, n_shingles, component_id for every row of ``docs`` (doc_id, text); see ``classes``."""
        return self.classes(docs).select("doc_id", "n_shingles", "component_id")

    def classes(self, docs: DataFrame) -> DataFrame:
        """doc_id, text_key (hash of the text), n_shingles, root (of the component), component_id for every row of ``docs``.

        A-Z are lower-cased; words are runs of characters other than space and U+0009 to U+000D. A set holds the
        distinct shingles, or the whole sequence where a text has fewer words than a shingle. component_id is the
        smallest doc_id that links reach, the row's own included. Null, empty and blank texts have an empty set, are
        linked with nothing and keep their own id. Equal texts share a set, whatever their ids; null ids never become
        a component_id unless a component has no other. Extra columns are ignored; an empty table gives no rows.
        """
        rows = materialize(self.documents(docs), "jaccard-documents")
        nodes = rows.where("open").select("node").distinct()
        sets = materialize(self.sets(docs, nodes), "jaccard-sets")
        roots = self.roots(self.links(sets))
        smallest = rows.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("doc"))
        smallest = smallest.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        component = smallest.groupBy("root").agg(F.min("doc").alias("component_id"))
        by_node = smallest.join(component, "root").select("node", "root", "component_id")
        full = rows.where("node IS NOT NULL").join(by_node, "node", "left").select("doc_id", "text_key", "n_shingles", "root", "component_id")
        none = F.lit(None).cast("bigint").alias("root")
        empty = rows.where("node IS NULL").select("doc_id", "text_key", "n_shingles", none, F.col("doc_id").alias("component_id"))
        discard(sets)
        return full.unionByName(empty)

    def first_of_each(self, docs: DataFrame) -> DataFrame:
        """The rows of ``docs`` (doc_id, text and more) without near duplicates: one row of each component, all columns.

        The row with the smallest id stays (one with an id before one without, then by a hash of the text); of rows with
        equal id and text in that place one stays, and it is not determined which. Rows without a word all stay, whatever
        their ids. Ids may repeat or be null: rows are told apart by id and text.
        """
        found = materialize(self.classes(docs), "jaccard-classes")
        row = F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")
        best = found.where("root IS NOT NULL").groupBy("root").agg(F.min(row).alias("best"))
        held = found.where("root IS NOT NULL").join(best, "root").withColumn("wins", row == F.col("best"))
        gone = materialize(held.where("NOT wins").select("doc_id", "text_key").distinct(), "jaccard-gone")
        twice = materialize(held.where("wins").groupBy("doc_id", "text_key").count().where("count > 1").select("doc_id", "text_key"), "jaccard-twice")
        discard(found)
        names = {c: f"{c}_{uuid4().hex[:8]}" for c in ("doc_id", "text_key")}
        keyed = docs.withColumns({names["doc_id"]: F.col("doc_id").cast("bigint"), names["text_key"]: F.xxhash64(F.col("text").cast("string"))})
        same = lambda other: F.col(names["doc_id"]).eqNullSafe(other["doc_id"]) & (F.col(names["text_key"]) == other["text_key"])
        gone = small(gone)
        kept = keyed.join(gone, same(gone), "left_anti")
        if not twice.isEmpty():
            again = small(twice)
            one = kept.join(again, same(again), "left_semi").dropDuplicates(list(names.values()))
            kept = kept.join(again, same(again), "left_anti").unionByName(one)
        return kept.select(*docs.columns)
