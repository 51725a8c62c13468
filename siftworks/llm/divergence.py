"""How far the sources of a language differ in their words: an audit by integer dictionaries.

Words are counted once, per group (language and source) and term, and summed
by task before they are exchanged. The sums go by ranges of language and term;
in a range the terms that enough documents hold are a sorted array, a term's
place in it, found by ``searchsorted``, is its id, and ``bincount`` of the ids
gives each group's dense vector over the range's chunk. Ids stand in the order
of the terms' UTF-8 bytes, so a smaller id is an earlier term in every tie.
Chunks then meet the groups of their language, in blocks, and give the partial
sums of each pair of groups and the best terms of each group. All arithmetic
is in integers.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import bounded_batches, partitions, staged

#: Letters of ASCII, A-Z as a-z, and all bytes of other characters are parts of terms; the rest separates.
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: A share is an integer in parts of 10**9.
DIGITS = 9


def group_terms(docs: DataFrame, most: int = 300_000) -> DataFrame:
    """``lang, source, term, n, docs``: occurrences of each term in a group and documents that hold it; no shuffle but the sum's.

    A group has a row of the empty term, which no text holds, so that groups
    without terms are there, too. A task holds some ``most`` terms at a time.
    """
    one, most_docs = 1 << 40, 1 << 20  # documents are counted above the occurrences, in one integer a term

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = defaultdict(dict)
        seen = 0

        def rows() -> pd.DataFrame:
            out = [(*group, term, both % one, both // one) for group, terms in held.items() for term, both in terms.items()]
            held.clear()
            frame = pd.DataFrame(out, columns=["lang", "source", "term", "n", "docs"])
            frame["term"] = [t.decode(errors="replace") for t in frame["term"]]
            return frame

        for pdf in batches:
            for lang, source, text in zip(pdf["lang"], pdf["source"], pdf["text"], strict=True):
                own = held[lang, source]
                own[b""] = 0
                get = own.get
                for term, count in Counter(text.encode().translate(_TERMS).split()).items():
                    own[term] = get(term, 0) + count + one
            seen += len(pdf)
            if seen >= most_docs or sum(map(len, held.values())) > most:
                yield rows()
                seen = 0
        if held:
            yield rows()

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = bounded_batches(docs).select(text("lang"), text("source"), text("text")).mapInPandas(run, "lang string, source string, term string, n long, docs long")
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Where the rows of sorted columns begin to differ from the row before."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = False
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def term_chunks(counts: DataFrame, least_docs: int = 10, width: int = 4096, held_rows: int = 1 << 16) -> DataFrame:
    """``lang, terms, sources, counts``: chunks of the kept terms of a language and dense counts of the sources that hold any.

    ``terms`` are sorted, ``counts`` are packed 64-bit integers, one row a
    source. The rows of a term, at most one a source, meet in one range.
    """

    def chunks(rows: pd.DataFrame) -> Iterator[tuple]:
        lang, term = rows["lang"].to_numpy(), rows["term"].to_numpy()
        edges = [*_runs(lang).tolist(), len(rows)]
        for i, j in zip(edges, edges[1:], strict=False):
            first = _runs(term[i:j])
            kept = term[i:j][first][np.add.reduceat(rows["docs"].to_numpy()[i:j], first) >= least_docs]
            step = max(1, min(width, (1 << 21) // len(set(rows["source"][i:j]))))  # a bounded number of cells
            for at in range(0, len(kept), step):
                names = kept[at : at + step]
                ids = np.searchsorted(names, term[i:j])
                mine = names[np.minimum(ids, len(names) - 1)] == term[i:j]
                source, of = np.unique(rows["source"].to_numpy()[i:j][mine], return_inverse=True)
                dense = np.bincount(of * len(names) + ids[mine], rows["n"].to_numpy()[i:j][mine], len(source) * len(names))
                yield lang[i], names.tolist(), source.tolist(), dense.astype("<i8").tobytes()  # one number a cell: exact to 2**53

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for pdf in batches:
            held.append(pdf)
            if sum(map(len, held)) < held_rows:
                continue
            rows = pd.concat(held, ignore_index=True)
            cut = int(_runs(rows["lang"].to_numpy(), rows["term"].to_numpy())[-1])  # the last term may go on
            yield pd.DataFrame(list(chunks(rows[:cut])) if cut else [], columns=["lang", "terms", "sources", "counts"])
            held = [rows[cut:]]
        if held:
            yield pd.DataFrame(list(chunks(pd.concat(held, ignore_index=True))), columns=["lang", "terms", "sources", "counts"])

    dealt = counts.filter("term <> ''").repartitionByRange(partitions(counts.sparkSession), "lang", "term").sortWithinPartitions("lang", "term", "source")
    return dealt.mapInPandas(run, "lang string, terms array<string>, sources array<string>, counts binary")


def shares(counts: np.ndarray, total: np.ndarray, terms: int) -> np.ndarray:
    """``1 + floor(10**9 (count + 2) / (total + 2 terms))``, digit by digit so that nothing overflows."""
    over, rest = np.divmod(counts + 2, total + 2 * terms)
    for _ in range(DIGITS):
        digit, rest = np.divmod(rest * 10, total + 2 * terms)
        over = over * 10 + digit
    return over + 1


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def _compare(best: int):
    """Of rows of a chunk and two blocks of groups of its language: sums of pairs, and the best terms of the groups of the first block."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict = {}
        top: dict = {}

        def rows() -> pd.DataFrame:
            out = [(lang, a, "pair", b, int(m[i, j])) for (lang, x, y), (names, others, m) in sums.items() for i, a in enumerate(names) for j, b in enumerate(others) if x != y or i < j]
            out += [(lang, source, "term", term, -value) for (lang, source), found in top.items() for value, term in found]
            sums.clear()
            top.clear()
            return pd.DataFrame(out, columns=["lang", "source", "part", "item", "value"])

        for pdf in batches:
            if len(sums) > 32:
                yield rows()
            for row in pdf.itertuples(index=False):
                terms, width = row.terms, len(row.terms)
                dense = np.frombuffer(row.counts, "<i8").reshape(-1, width)
                place = {s: i for i, s in enumerate(row.sources)}

                def side(names, totals, dense=dense, place=place, width=width, kept=row.kept):
                    own = np.zeros((len(names), width), np.int64)
                    for i, name in enumerate(names):
                        if name in place:
                            own[i] = dense[place[name]]
                    return own, shares(own, np.asarray(totals, np.int64)[:, None], kept)

                left, p = side(row.a_sources, row.a_totals)
                same = row.a == row.b
                right = p if same else side(row.b_sources, row.b_totals)[1]
                block = sums.setdefault((row.lang, row.a, row.b), [list(row.a_sources), list(row.b_sources), np.zeros((len(p), len(right)), np.int64)])
                for i in range(len(p)):
                    block[2][i] += distance(p[i], right).sum(axis=1)
                if not same:
                    continue
                q = shares(dense.sum(axis=0), np.int64(row.lang_total), row.kept)
                f = np.where((left > 0) & (p > q), distance(p, q), -1)
                for i, name in enumerate(row.a_sources):
                    order = np.argsort(-f[i], kind="stable")[:best]  # equal ones in the order of their ids
                    found = [(-int(f[i, t]), terms[t]) for t in order.tolist() if f[i, t] >= 0]
                    top[row.lang, name] = sorted([*top.get((row.lang, name), []), *found])[:best]
        yield rows()

    return run


def audit_sources(docs: DataFrame, least_docs: int = 10, best: int = 10, block: int = 256, width: int = 4096) -> DataFrame:
    """``lang, source, part, item, value, rank``: distances between the sources of a language, and the terms that set a source apart.

    ``docs`` has ``lang, source, text``; nulls count as empty strings, which
    are a language and a source like any other; other columns are ignored.
    Repeated rows are documents of their own. A language keeps the terms in
    at least ``least_docs`` of its documents. Part ``pair`` has each other
    source of the language with the symmetric chi-square distance of the
    smoothed shares in parts of 10**9, part ``term`` the up to ``best`` terms
    with a greater share in the source than in its language. Ties go to the
    earlier item by UTF-8 bytes. A language without kept terms has pairs of
    value 0; one of a single source has no pairs; an empty table gives an
    empty one. Counts are exact up to 2**53 a group and term.

    A chunk meets the language's groups in blocks of about ``block``, so a
    task holds two blocks of ``width`` terms at a time, however many sources
    or terms there are; chunks of a frequent language are dealt to many tasks.
    """
    spark = docs.sparkSession
    counts = staged(group_terms(docs), "audit-counts")
    chunks = staged(term_chunks(counts, least_docs, width).withColumn("salt", F.pmod(F.xxhash64("lang", F.element_at("terms", 1)), F.lit(partitions(spark))).cast("int")), "audit-chunks")

    kept = chunks.groupBy("lang").agg(F.sum(F.size("terms")).cast("long").alias("kept"))
    n = F.expr("transform(sequence(0, size(sources) - 1), i -> named_struct('source', sources[i], 'n', counts_of[i]))")
    summed = chunks.select("lang", "sources", "counts", F.size("terms").alias("width")).mapInPandas(_totals, "lang string, sources array<string>, counts_of array<long>")
    totals = summed.select("lang", F.explode(n).alias("x")).groupBy("lang", "x.source").agg(F.sum("x.n").alias("n"))
    groups = counts.filter("term = ''").select("lang", "source").join(totals, ["lang", "source"], "left").join(kept, "lang", "left").fillna(0, ["n", "kept"])
    groups = staged(groups, "audit-groups")
    size = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("lang_total"), F.first("kept").alias("kept"))
    most = size.agg(F.max("m")).first()[0] or 1
    groups = groups.withColumn("block", F.pmod(F.xxhash64("source"), F.lit(-(-most // block))).cast("int"))
    blocks = groups.groupBy("lang", "block").agg(F.array_sort(F.collect_list(F.struct("source", "n"))).alias("xs"))
    blocks = staged(blocks.join(size.select("lang", "lang_total", "kept"), "lang"), "audit-blocks")
    side = lambda x: blocks.select("lang", F.col("block").alias(x), F.col("xs.source").alias(f"{x}_sources"), F.col("xs.n").alias(f"{x}_totals"), *(["lang_total", "kept"] if x == "a" else []))
    met = side("a").join(side("b"), "lang").filter("a <= b")

    # the blocks go to every salt that has chunks of their language
    salted = chunks.select("lang", "salt").distinct().join(met, "lang")
    work = chunks.join(salted, ["lang", "salt"]).drop("salt")
    found = staged(bounded_batches(work).mapInPandas(_compare(best), "lang string, source string, part string, item string, value long"), "audit-parts")

    # every pair, those of languages without kept terms, too
    listed = met.select("lang", F.col("a_sources"), F.explode("b_sources").alias("item"), (F.col("a") == F.col("b")).alias("same")).select("lang", F.explode("a_sources").alias("source"), "item", "same").filter("not same or source < item")
    pairs = found.filter("part = 'pair'").select("lang", "source", "item", "value").unionByName(listed.select("lang", "source", "item", F.lit(0).cast("long").alias("value")))
    pairs = pairs.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = pairs.select("lang", F.explode(F.array(F.struct("source", "item", "value"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"), "value"))).alias("x")).select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "x.value")
    place = F.row_number().over(W.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item"))
    every = both.unionByName(found.filter("part = 'term'")).withColumn("rank", place)
    return every.filter((F.col("part") == "pair") | (F.col("rank") <= best)).select("lang", "source", "part", "item", "value", "rank")


def _totals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        sums = [np.frombuffer(c, "<i8").reshape(-1, w).sum(axis=1) for c, w in zip(pdf["counts"], pdf["width"], strict=True)]
        yield pd.DataFrame({"lang": pdf["lang"], "sources": pdf["sources"], "counts_of": sums})
