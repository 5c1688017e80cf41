"""Global ids over a recording: matches, merges with a guard, recent tracks, new ids, conflicts.

What can be told frame by frame (pairs within a radius and their best one-to-one matches) is done
by Spark over all frames. What depends on the frames before is an ordered fold over one recording
(an environment and a day), each a group of its own: its rows are the tracks and matches only.
"""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackmill.operators.identity import camera_pairs, matched
from trackmill.sources import views as V

#: Frames for which a track is remembered, and the distance within which it is taken up again.
RECENT, REACH = 6, 20.0


class Registry:
    """Which global id each (camera, track) has."""

    def __init__(self) -> None:
        self.of: dict[tuple, str] = {}
        self.tracks: dict[str, set[tuple]] = defaultdict(set)
        self.made = 0

    def new(self) -> str:
        self.made += 1
        return f"P{self.made}"

    def force(self, key: tuple, gid: str) -> None:
        """The track alone gets the id, whatever it had."""
        if key in self.of:
            self.tracks[self.of[key]].discard(key)
        self.of[key] = gid
        self.tracks[gid].add(key)

    def merge(self, target: str, source: str) -> None:
        if target != source:
            for key in list(self.tracks.pop(source, ())):
                self.of[key] = target
                self.tracks[target].add(key)

    def assign(self, key: tuple, gid: str) -> None:
        """The track gets the id; had it another, all tracks of that one come along."""
        if key in self.of:
            self.merge(gid, self.of[key])
        else:
            self.force(key, gid)

    def shared(self, gid: str) -> bool:
        return len({camera for camera, _ in self.tracks.get(gid, ())}) > 1


def resolve_matches(r: Registry, matches: list[tuple[tuple, tuple]], active: dict[str, set[str]]) -> None:
    """Ids of matched tracks: two ids become the smaller unless both are active in one camera, one
    id goes to both, and without any there is a new one."""
    for a, b in matches:
        x, y = r.of.get(a), r.of.get(b)
        if x and y:
            target, source = min(x, y), max(x, y)
            if x != y and not active.get(target, set()) & active.get(source, set()):
                r.merge(target, source)
                active.setdefault(target, set()).update(active.pop(source, set()))
            continue
        gid = x or y or r.new()
        r.assign(a, gid)
        r.assign(b, gid)
        active.setdefault(gid, set()).update((a[0], b[0]))


def resolve_frame(r: Registry, tracks: list[tuple], matches: list[tuple[tuple, tuple]], recent: list[tuple], frame: int) -> list[tuple]:
    """One frame: tracks (camera, track, x, y, conf) to (camera, track, gid); recent is brought up to date."""
    active: dict[str, set[str]] = defaultdict(set)
    for camera, track, *_ in tracks:
        if (camera, track) in r.of:
            active[r.of[camera, track]].add(camera)
    resolve_matches(r, matches, active)
    recent[:] = [x for x in recent if frame - x[0] <= RECENT]
    near = []
    for camera, track, x, y, _ in tracks:
        if (camera, track) not in r.of:
            found = sorted(((x - px) ** 2 + (y - py) ** 2, gid) for _, other, gid, px, py in recent if other != camera)
            if found and found[0][0] <= REACH**2:
                near.append((found[0][0], camera, track, found[0][1]))
    claimed = set()
    for _, camera, track, gid in sorted(near):  # the nearest first, each id once
        if gid not in claimed:
            claimed.add(gid)
            r.assign((camera, track), gid)
    for camera, track, *_ in tracks:
        if (camera, track) not in r.of:
            r.force((camera, track), r.new())
    seen = set()
    for camera, track, _, _, _ in sorted(tracks, key=lambda t: (t[0], -t[4], t[1])):  # of equal ids in a camera the most confident keeps it
        if (camera, r.of[camera, track]) in seen:
            r.force((camera, track), r.new())
        seen.add((camera, r.of[camera, track]))
    recent += [(frame, camera, r.of[camera, track], x, y) for camera, track, x, y, _ in tracks]
    return [(camera, track, r.of[camera, track]) for camera, track, *_ in tracks]


def resolved(frames: DataFrame, matches: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, frame, camera, track, gid): the id of each track of frames (keys, frame, camera,
    track, x, y, conf) after its frame, by matches (keys, frame, camera, track, b_camera, b_track, dist)."""
    kinds = {f.name: f.dataType.simpleString() for f in frames.schema}
    out = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", frame long, camera string, track long, gid string"
    none = lambda t: F.lit(None).cast(t)
    rows = frames.select(*keys, "frame", F.lit(1).alias("kind"), "camera", "track", "x", "y", "conf", none("string").alias("b_camera"), none("long").alias("b_track"))
    rows = rows.unionByName(matches.select(*keys, "frame", F.lit(0).alias("kind"), "camera", "track", F.col("dist").alias("x"), none("double").alias("y"), none("double").alias("conf"), "b_camera", "b_track"))

    def fold(key: tuple, x: pd.DataFrame) -> pd.DataFrame:
        r, recent, found = Registry(), [], []
        x = x.sort_values(["frame", "kind", "camera", "b_camera", "track", "b_track"], kind="stable")
        for frame, part in x.groupby("frame", sort=True):
            pairs = part[part["kind"] == 0]
            pairs = [((a, int(t)), (b, int(u))) for a, t, b, u in zip(pairs["camera"], pairs["track"], pairs["b_camera"], pairs["b_track"])]
            tracks = part[part["kind"] == 1]
            tracks = [(c, int(t), px, py, conf) for c, t, px, py, conf in zip(tracks["camera"], tracks["track"], tracks["x"], tracks["y"], tracks["conf"])]
            found += [(*key, frame, *row) for row in resolve_frame(r, tracks, pairs, recent, int(frame))]
        return pd.DataFrame(found, columns=[*keys, "frame", "camera", "track", "gid"])

    return rows.groupBy(*keys).applyInPandas(fold, out)


# --- queries

def resolved_ids(s: SparkSession, d: str) -> DataFrame:
    """Global ids of all tracks, recording after recording; a recording is an environment's day."""
    f = V.frames(s, d).withColumn("day", F.floor(F.col("frame") / 24))
    m = matched(camera_pairs(V.frames(s, d))).withColumn("day", F.floor(F.col("frame") / 24))
    return resolved(f, m, ["env", "day"])


def shared_global_ids(s: SparkSession, d: str) -> DataFrame:
    """Of each recording's last ids of its tracks: how many there are, and how many span cameras."""
    last = resolved_ids(s, d).groupBy("env", "day", "camera", "track").agg(F.max_by("gid", "frame").alias("gid"))
    one = last.groupBy("env", "day", "gid").agg(F.count_distinct("camera").alias("cameras"), F.count("*").alias("tracks"))
    return one.groupBy("env", "day").agg(F.count("*").alias("ids"), F.count_if(F.col("cameras") > 1).alias("shared"), F.max("tracks").alias("most_tracks"))


QUERIES = {f.__name__: f for f in (resolved_ids, shared_global_ids)}
#: An ordered fold can't be said in SQL; tests hold it against cases.
SQL: dict[str, str] = {}
