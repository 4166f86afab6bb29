"""Clusters and verdicts of a stream, as of each arrival, with a state for each repository.

The state is keyed by what an arrival needs: the buckets of its signatures' bands, the
members in them and the links of those it reaches.  An arrival reads its own buckets and its
own cluster, never the repository.  Members lapse after 14 days: they are passed over
when met and removed by the day they came.  A request that comes again is a member more.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from gleaner.functions.text import STYLE
from gleaner.operators import engine, rules
from gleaner.operators.clusters import TTL_SECS, WINDOW_SECS, burst_score
from gleaner.operators.signatures import BANDS, NEAR_HAMMING, NEAR_JACCARD, PERMS

OUT = "repo string, id long, size long, distinct_authors long, in_window long, style_cohesion double, carried string"
DAY = 86400


def buckets(sim: int | None, mins: list[int] | None) -> list[str]:
    """The keys of a signature's bands."""
    out = [] if sim is None else [f"s{k}:{sim >> (15 * k) & 0x7FFF}" for k in range(4)]
    if mins is not None:
        x = np.array(mins, np.int64).reshape(BANDS, PERMS // BANDS)
        out += [f"m{k}:{hashlib.blake2b(row.tobytes(), digest_size=8).hexdigest()}" for k, row in enumerate(x)]
    return out


def near(sim_a, mins_a, sim_b, mins_b) -> bool:
    """Whether two signatures share a band and agree in the diff or the text."""
    if sim_a is not None and sim_b is not None:
        x = int(sim_a) ^ int(sim_b)
        if x.bit_count() <= NEAR_HAMMING and any(not (x >> (15 * k)) & 0x7FFF for k in range(4)):
            return True
    if mins_a is not None and mins_b is not None:
        same = np.asarray(mins_a) == np.asarray(mins_b)
        return bool(same.mean() >= NEAR_JACCARD and same.reshape(BANDS, PERMS // BANDS).all(1).any())
    return False


def cohesion(styles: np.ndarray) -> float:
    """The mean cosine of the rows to their mean; a row without length counts 0."""
    mean = styles.mean(0)
    norm = np.sqrt((styles**2).sum(1)) * np.sqrt((mean**2).sum())
    return float(np.divide(styles @ mean, norm, out=np.zeros(len(styles)), where=norm > 0).mean())


class Clusters(StatefulProcessor):
    """Rows (repo, id, author, secs, sim, mins, style, carried): each reports its cluster."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.count = handle.getValueState("count", "n long")
        self.members = handle.getMapState("members", "seq long", "author string, secs long, sim long, mins array<long>, style array<double>, near array<long>")
        self.bands = handle.getMapState("bands", "band string", "seqs array<long>")
        self.days = handle.getMapState("days", "day long", "seqs array<long>")

    def _lapse(self, now: int) -> None:
        for (day,) in [tuple(k) for k in self.days.keys()]:
            if (day + 1) * DAY <= now - TTL_SECS:
                for seq in self.days.getValue((day,))[0]:
                    if self.members.containsKey((seq,)):
                        m = self.members.getValue((seq,))
                        for b in buckets(m[2], None if m[3] is None else list(m[3])):
                            left = [x for x in self.bands.getValue((b,))[0] if x != seq] if self.bands.containsKey((b,)) else []
                            self.bands.updateValue((b,), (left,)) if left else self.bands.removeKey((b,))
                        self.members.removeKey((seq,))
                self.days.removeKey((day,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        out, known = [], {}

        def member(seq: int):
            if seq not in known:
                known[seq] = list(self.members.getValue((seq,))) if self.members.containsKey((seq,)) else None
            return known[seq]

        seq = int(self.count.get()[0]) if self.count.exists() else 0
        for row in pd.concat(list(rows)).sort_values(["secs", "id"], kind="stable").itertuples():
            now = int(row.secs)
            sim = None if pd.isna(row.sim) else int(row.sim)
            mins = None if row.mins is None else [int(x) for x in row.mins]
            live = lambda s, now=now: (m := member(s)) is not None and m[1] >= now - TTL_SECS
            keys = buckets(sim, mins)
            held = {b: [int(x) for x in self.bands.getValue((b,))[0]] if self.bands.containsKey((b,)) else [] for b in keys}
            own = [s for s in sorted({s for l in held.values() for s in l}) if live(s) and near(sim, mins, member(s)[2], member(s)[3])]
            known[seq] = [row.author, now, sim, mins, [float(x) for x in row.style], own]
            self.members.updateValue((seq,), tuple(known[seq]))
            for s in own:
                known[s][5] = [*map(int, known[s][5] if known[s][5] is not None else []), seq]
                self.members.updateValue((s,), tuple(known[s]))
            for b, l in held.items():
                self.bands.updateValue((b,), ([*l, seq],))
            day = now // DAY
            self.days.updateValue((day,), ([*(self.days.getValue((day,))[0] if self.days.containsKey((day,)) else []), seq],))
            group, seen = [seq], {seq}
            for a in group:
                for b in map(int, member(a)[5] if member(a)[5] is not None else []):
                    if b not in seen and live(b):
                        seen.add(b)
                        group.append(b)
            m = [member(g) for g in group]
            out.append((key[0], int(row.id), len(group), len({x[0] for x in m}), sum(now - x[1] <= WINDOW_SECS for x in m), cohesion(np.array([list(x[4]) for x in m])), row.carried))
            seq += 1
            self._lapse(now)
        self.count.update((seq,))
        yield pd.DataFrame(out, columns=["repo", "id", "size", "distinct_authors", "in_window", "style_cohesion", "carried"])

    def close(self) -> None:
        pass


def clusters(arrivals: DataFrame) -> DataFrame:
    """The cluster of each arrival of a stream of (repo, id, author, secs, sim, mins, the style columns) and carried, if there."""
    carried = F.col("carried") if "carried" in arrivals.columns else F.lit(None).cast("string")
    slim = arrivals.select("repo", "id", "author", "secs", "sim", "mins", F.array(*[F.col(k).cast("double") for k in STYLE]).alias("style"), carried.alias("carried"))
    return slim.groupBy("repo").transformWithStateInPandas(Clusters(), OUT, "append", "None")


def with_views(arrivals: DataFrame) -> DataFrame:
    """(repo, id, fires, the cluster's view) of a stream of arrivals that have their own rules' fires: those of the cluster follow."""
    v = clusters(arrivals.withColumn("carried", F.to_json("fires")))
    v = v.withColumns({"distinct_repos": F.lit(1).cast("long"), "burst": burst_score()(F.col("in_window"))})
    own = F.from_json("carried", "array<struct<rule:string,value:double>>")
    v = rules.fires(v, rules.cluster_rules(), "of_cluster").withColumn("fires", F.concat(F.coalesce(own, F.array().cast("array<struct<rule:string,value:double>>")), "of_cluster"))
    return v.drop("carried", "of_cluster")


def verdicts(arrivals: DataFrame, current: Callable[[], engine.Weights], sink: Callable[[DataFrame, int], None], checkpoint: str | None = None):
    """A writer of scored and planned arrivals; each micro-batch asks for the weights that hold then, so a promotion needs no restart."""

    def score(batch: DataFrame, k: int) -> None:
        sink(engine.planned(engine.score(batch, current())), k)

    w = with_views(arrivals).writeStream.foreachBatch(score).outputMode("append")
    return w.option("checkpointLocation", checkpoint) if checkpoint else w

