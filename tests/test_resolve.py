"""Global ids over a recording: the registry's rules, the merge guard, and whole frames."""

from trackmill.operators import resolve
from trackmill.operators.resolve import Registry, resolve_frame, resolve_matches


def test_assigning_another_id_merges_and_forcing_does_not():
    r = Registry()
    r.assign(("a", 1), "X")
    r.assign(("b", 2), "X")
    r.assign(("c", 3), "Y")
    assert r.shared("X") and not r.shared("Y") and not r.shared("none")
    r.assign(("a", 1), "Y")  # X and Y are one person
    assert set(r.of.values()) == {"Y"} and r.tracks["Y"] == {("a", 1), ("b", 2), ("c", 3)} and "X" not in r.tracks
    r.force(("b", 2), "Z")
    assert r.of["b", 2] == "Z" and r.of["a", 1] == r.of["c", 3] == "Y"
    r.assign(("d", 4), "X")  # an id that was merged away starts anew
    assert r.tracks["X"] == {("d", 4)}
    r.merge("Y", "Y")
    assert r.of["a", 1] == "Y"


def test_merges_take_the_smaller_id_unless_both_are_in_one_camera():
    r = Registry()
    r.force(("a", 1), "P2")
    r.force(("b", 2), "P1")
    resolve_matches(r, [(("a", 1), ("b", 2))], {"P2": {"a"}, "P1": {"b"}})
    assert r.of["a", 1] == r.of["b", 2] == "P1"
    r = Registry()
    for key, gid in ((("a", 1), "P1"), (("b", 2), "P2"), (("a", 3), "P2")):
        r.force(key, gid)
    resolve_matches(r, [(("a", 1), ("b", 2))], {"P1": {"a"}, "P2": {"a", "b"}})
    assert r.of["a", 1] == "P1" and r.of["b", 2] == "P2"
    # after a merge the guard knows the cameras of both
    r = Registry()
    for key, gid in ((("a", 1), "P1"), (("b", 2), "P2"), (("b", 3), "P3")):
        r.force(key, gid)
    resolve_matches(r, [(("a", 1), ("b", 2)), (("a", 1), ("b", 3))], {"P1": {"a"}, "P2": {"b"}, "P3": {"b"}})
    assert r.of["b", 2] == "P1" and r.of["b", 3] == "P3"
    # one id goes to both; none gives a new one
    r = Registry()
    r.force(("a", 1), "P7")
    resolve_matches(r, [(("a", 1), ("b", 2)), (("c", 3), ("d", 4))], {})
    assert r.of["b", 2] == "P7" and r.of["c", 3] == r.of["d", 4] == "P1"


def test_frames():
    r, recent = Registry(), []
    first = resolve_frame(r, [("a", 1, 0.0, 0.0, 0.9), ("b", 2, 1.0, 0.0, 0.9), ("c", 3, 500.0, 0.0, 0.5)], [(("a", 1), ("b", 2))], recent, 1)
    assert first == [("a", 1, "P1"), ("b", 2, "P1"), ("c", 3, "P2")]
    # two new tracks near a recent one of another camera: the nearer takes the id, the other a new one
    later = resolve_frame(r, [("d", 4, 3.0, 0.0, 0.9), ("e", 5, 2.0, 0.0, 0.9), ("c", 6, 500.0, 0.0, 0.9)], [], recent, 4)
    assert later == [("d", 4, "P3"), ("e", 5, "P1"), ("c", 6, "P4")]
    # forgotten after RECENT frames
    assert resolve_frame(r, [("f", 7, 2.0, 0.0, 0.9)], [], recent, 5 + resolve.RECENT) == [("f", 7, "P5")]
    # equal ids in one camera: the most confident keeps it
    r.force(("a", 8), "P1")
    assert resolve_frame(r, [("a", 1, 0.0, 0.0, 0.3), ("a", 8, 9.0, 0.0, 0.8)], [], recent, 50) == [("a", 1, "P6"), ("a", 8, "P1")]


def test_recordings_are_folded_apart(spark):
    frames = spark.createDataFrame([(e, f, c, t, float(x), 0.0, 0.9) for e in ("u", "v") for f, c, t, x in ((1, "a", 1, 0), (1, "b", 2, 3), (2, "a", 1, 0), (2, "b", 3, 900))], "env string, frame long, camera string, track long, x double, y double, conf double")
    matches = spark.createDataFrame([("u", 1, "a", 1, "b", 2, 3.0)], "env string, frame long, camera string, track long, b_camera string, b_track long, dist double")
    got = {(r.env, r.frame, r.camera, r.track): r.gid for r in resolve.resolved(frames, matches, ["env"]).collect()}
    assert len(got) == 8 and got["u", 1, "a", 1] == got["u", 1, "b", 2] == got["u", 2, "a", 1] == "P1" and got["u", 2, "b", 3] == "P2"
    assert got["v", 1, "a", 1] == "P1" and got["v", 1, "b", 2] == "P2" and got["v", 2, "b", 3] == "P3"
    assert resolve.resolved(frames.limit(0), matches, ["env"]).count() == 0
