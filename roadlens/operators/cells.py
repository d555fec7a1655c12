"""Exact nearest neighbours by cells: a block of queries against a block of the store.

Both sides are cut into blocks of bounded size by the hash of their rows; Spark shuffles each pair of blocks to one call, which
scores it as matrix products and returns the ``k`` best per query. Only those leave the cell, so what is shuffled is the
two sides once a block of the other and ``k`` rows a query and store block, never the pairs. Matrix products choose the candidates, with a
margin above their rounding error; candidates are scored anew in the order of ``vectors.dot``, so scores and ties are those of
the Column form. Equal vectors of a block are scored once.

Order of a query's documents: score descending (NaN greatest, null last), then document id ascending (null first). A score is null
where a vector is null, holds a null, or has another length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: rows of a block at most (a vector of 64 doubles: 4 MB of queries, 32 MB of the store) and at least, scores held at a time
QUERY_BLOCK, STORE_BLOCK, LEAST_BLOCK = 8192, 65536, 2048
SCORES = 1 << 22


def _blocks(queries: DataFrame, store: DataFrame, query_block: int, store_block: int) -> tuple[int, int]:
    """Blocks of both sides: as few as their sizes allow, or enough for all cores."""
    n_q, n_s = queries.count(), store.count()
    q, s = max(1, -(-n_q // query_block)), max(1, -(-n_s // store_block))
    cores = queries.sparkSession.sparkContext.defaultParallelism
    return q, max(s, min(-(-cores // q), n_s // LEAST_BLOCK))


def best_pairs(queries: DataFrame, store: DataFrame, k: int, distance: bool = False, query_block: int | None = None, store_block: int | None = None) -> DataFrame:
    """(query_id, doc_id, score, further columns of both) of each cell's ``k`` best documents per query: the ``k`` best of the
    whole store are among them. ``queries`` has query_id and ``_qv``, ``store`` doc_id and ``_dv`` (arrays of double);
    score: their dot product, or with ``distance`` the negative L2 distance."""
    n_q, n_s = _blocks(queries, store, query_block or QUERY_BLOCK, store_block or STORE_BLOCK)
    more_q, more_s = ([c for c in x.columns if c not in used] for x, used in ((queries, ("query_id", "_qv")), (store, ("doc_id", "_dv"))))
    kinds = dict(queries.dtypes) | dict(store.dtypes) | {"score": "double"}
    names = ["query_id", "doc_id", "score", *more_q, *more_s]
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    at = lambda n, *cols: F.pmod(F.xxhash64(*cols), F.lit(n)).cast("int")
    asked = queries.withColumn("_cq", at(n_q, "query_id", "_qv")).withColumn("_cs", every(n_s))
    held = store.withColumn("_cs", at(n_s, "doc_id", "_dv")).withColumn("_cq", every(n_q))
    cell = _cell(k, distance, more_q, more_s, names)
    return asked.groupBy("_cq", "_cs").cogroup(held.groupBy("_cq", "_cs")).applyInArrow(cell, ", ".join(f"`{c}` {kinds[c]}" for c in names))


def _cell(k: int, distance: bool, more_q: list[str], more_s: list[str], names: list[str]):
    """The call of a cell; built inside a function, so workers need no copy of the package."""
    import numpy as np

    limit = SCORES

    def vectors(column):
        """{length: (rows, matrix)} of a list column without nulls."""
        import pyarrow as pa

        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        n = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        values = column.flatten()
        gap = values.is_null().to_numpy(zero_copy_only=False)
        flat = values.fill_null(0.0).to_numpy(zero_copy_only=False)
        start = np.cumsum(n) - n
        gaps = np.concatenate([[0], np.cumsum(gap)])
        whole = column.is_valid().to_numpy(zero_copy_only=False) & (gaps[start + n] == gaps[start])
        out = {}
        for d in np.unique(n[whole]):
            rows = np.flatnonzero(whole & (n == d))
            out[int(d)] = rows, flat[start[rows][:, None] + np.arange(d)].reshape(len(rows), int(d))
        return out

    def exact(q, v):
        """Scores of matching rows, summed from the first number to the last."""
        total = np.zeros(len(q))
        for j in range(q.shape[1]):
            a, b = q[:, j], v[:, j]
            total += (a - b) * (a - b) if distance else a * b
        return -np.sqrt(total) if distance else total

    def all_exact(q, v):
        total = np.zeros((len(q), len(v)))
        for j in range(q.shape[1]):
            a, b = q[:, j, None], v[None, :, j]
            total += (a - b) * (a - b) if distance else a * b
        return -np.sqrt(total) if distance else total

    def at_least_kth(s, slack):
        kth = np.partition(s, s.shape[1] - k, axis=1)[:, -k] if s.shape[1] > k else np.full(len(s), -np.inf)
        return np.nonzero(s >= (kth - slack)[:, None])

    def candidates(q, v, qq, vv):
        """(query, vector, score): all that can be among the k best."""
        finite = np.isfinite(vv)
        parts = []
        for part in (np.flatnonzero(finite), np.flatnonzero(~finite)):
            if not len(part):
                continue
            u, uu = v[part], vv[part]
            with np.errstate(all="ignore"):
                s = q @ u.T
                top = np.sqrt(qq * uu.max()) if not distance else qq + uu.max()
                if distance:
                    s = 2 * s - qq[:, None] - uu
                slack = 64 * (q.shape[1] + 4) * np.finfo(float).eps * top + 1e-300
                if np.isfinite(s).all() and np.isfinite(slack).all():
                    i, j = at_least_kth(s, slack)
                    score = np.concatenate([exact(q[i[a:a + (1 << 16)]], u[j[a:a + (1 << 16)]]) for a in range(0, len(i), 1 << 16)])
                else:
                    s = all_exact(q, u)
                    i, j = at_least_kth(np.where(np.isnan(s), np.inf, s), np.zeros(len(q)))
                    score = s[i, j]
            parts.append((i, part[j], score))
        return [np.concatenate(x) for x in zip(*parts)]

    def first_k(i, score, place):
        """Indices of the k first per query, by (NaN, score descending, place)."""
        nan = np.isnan(score)
        order = np.lexsort((place, np.where(nan, 0.0, -score), ~nan, i))
        i = i[order]
        return order[np.arange(len(i)) - np.searchsorted(i, i) < k]

    def run(asked, held):
        import pyarrow as pa
        import pyarrow.compute as pc

        found = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0), np.zeros(0, bool))]  # query, place, score, without a score
        if asked.num_rows and held.num_rows:
            held = held.take(pc.sort_indices(held, sort_keys=[("doc_id", "ascending")], null_placement="at_start"))  # a row's place is its order
            stored = vectors(held["_dv"])
            scored = np.zeros(asked.num_rows, int)
            dims = np.full(asked.num_rows, -1)
            for d, (rows, q) in vectors(asked["_qv"]).items():
                dims[rows] = d
                if d not in stored:
                    continue
                places, v = stored[d]
                if d:
                    _, first, kind = np.unique(np.ascontiguousarray(v).view(np.dtype((np.void, 8 * d))).ravel(), return_index=True, return_inverse=True)
                else:
                    first, kind = np.zeros(1, int), np.zeros(len(v), int)
                v, kind = v[first], kind.ravel()
                members = places[np.argsort(kind, kind="stable")]
                size = np.bincount(kind, minlength=len(v))
                begin = np.cumsum(size) - size
                with np.errstate(all="ignore"):
                    vv = (v * v).sum(axis=1)
                    qq = (q * q).sum(axis=1)
                step = max(1, min(1024, limit // len(v)))
                for a in range(0, len(q), step):
                    i, j, score = candidates(q[a:a + step], v, qq[a:a + step], vv)
                    best = first_k(i, score, members[begin[j]])
                    i, j, score = i[best], j[best], score[best]
                    n = np.minimum(size[j], k)
                    i, score = np.repeat(i, n), np.repeat(score, n)
                    place = members[np.repeat(begin[j], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
                    best = first_k(i, score, place)
                    found.append((rows[a + i[best]], place[best], score[best], np.zeros(len(best), bool)))
                    scored += np.bincount(found[-1][0], minlength=len(scored))
            short = np.flatnonzero(scored < min(k, held.num_rows))
            for d in np.unique(dims[short]):  # pairs without a score come last
                none = np.ones(held.num_rows, bool)
                if d in stored:
                    none[stored[d][0]] = False
                places = np.flatnonzero(none)[:k]
                mine = short[dims[short] == d]
                n = np.minimum(k - scored[mine], len(places))
                at = places[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
                found.append((np.repeat(mine, n), at, np.zeros(len(at)), np.ones(len(at), bool)))
        query, place, score, none = (np.concatenate(x) for x in zip(*found))
        asked, held = asked.take(pa.array(query)), held.take(pa.array(place))
        cols = {c: asked[c] for c in ["query_id", *more_q]} | {c: held[c] for c in ["doc_id", *more_s]} | {"score": pa.array(score, mask=none)}
        return pa.table({c: cols[c] for c in names})

    return run
