"""Readers of the studied file formats, on small files written here."""

import json

from roadlens.sources import files as fs


def test_read_trajectories_units(spark, tmp_path):
    for name, v in (("2021-01-01-00-00-00_a", 36.0), ("i680_drive", 10.0)):
        d = tmp_path / name
        d.mkdir()
        (d / "trajectory.csv").write_text(
            "index,Time,Velocity,Acceleration,LatitudeGPS,LongitudeGPS\n0,0.0,%s,0.1,36.0,-86.6\n1,0.1,%s,0.2,36.0,-86.6\n" % (v, v))
    df = fs.read_trajectories(spark, str(tmp_path / "*" / "trajectory.csv"))
    got = {(r.traj_id, r.seq): r.speed for r in df.collect()}
    assert got[("2021-01-01-00-00-00_a", 0)] == 10.0  # km/h -> m/s
    assert got[("i680_drive", 1)] == 10.0  # i680 already m/s


def test_read_tse_long_form(spark, tmp_path):
    d = tmp_path / "drive1"
    d.mkdir()
    for name, base in (("speed", 20.0), ("confidence", 0.5), ("cvalue", 3.0)):
        (d / f"{name}.csv").write_text(f"time, 0, 1\n-1.0,{base},{base + 1}\n60.0,{base + 2},{base + 3}\n")
    (d / "segments.json").write_text(json.dumps([0.0, 500.0]))
    rows = fs.read_tse(spark, str(tmp_path / "drive1")).collect()
    assert len(rows) == 4
    r = [x for x in rows if x.t == 60.0 and x.seg_idx == 1][0]
    assert (r.avg_speed, r.confidence, r.cvalue, r.seg_start) == (23.0, 3.5, 6.0, 500.0)


def test_read_emissions_names(spark, tmp_path):
    header = ",".join(fs.EMISSION_COLUMNS)
    row = ",".join(["0.0", "0", "1_rl_av"] + ["1.0"] * 8 + ["", ""] + ["0.0"] * 15)
    for fname in ("x_rl_fs_traj9.csv", "x_idm_traj9.csv"):
        (tmp_path / fname).write_text(header + "\n" + row + "\n")
    df = fs.read_emissions(spark, str(tmp_path))
    got = sorted((r.controller, r.trajectory) for r in df.collect())
    assert got == [("idm", "traj9"), ("rl_fs", "traj9")]


def test_null_tokens_and_rag_json_and_road_fit(spark, tmp_path):
    (tmp_path / "n.csv").write_text("a,b\nNULL,1.5\nN/A,x\n,2\n3,NaN\n")
    rows = fs.read_null_csv(spark, str(tmp_path / "n.csv"), ["a", "b"]).collect()
    assert [(r.a, r.b) for r in rows] == [(None, 1.5), (None, None), (None, 2.0), (3.0, None)]
    doc = {"current_situation": {"speed": 10.0, "headway": 20.0, "leader_speed": 11.0},
           "action_explanation": "keep", "action": "a", "hypothetical_situation": "h",
           "situation_analysis": "s", "embedding_model": "m"}
    (tmp_path / "doc.json").write_text(json.dumps(doc, indent=2))
    r = fs.read_rag_json(spark, str(tmp_path / "doc.json")).collect()[0]
    assert r.current_situation.headway == 20.0 and r.action_explanation == "keep"
    (tmp_path / "g.csv").write_text("interval_number,interval_start,interval_end,slope,intercept\n1,0.0,0.2,1.0,0.5\n")
    g = fs.read_road_fit(spark, str(tmp_path / "g.csv")).collect()[0]
    assert (g.interval_end, g.slope) == (0.2, 1.0)


def test_read_traffic_state(spark, tmp_path):
    (tmp_path / "ts.csv").write_text('data,freeflow,congestion,dense\nd_1_300,"[[0, 150]]",[],"[[150, 299]]"\n')
    rows = sorted((r.state, r.start, r.end) for r in fs.read_traffic_state(spark, str(tmp_path / "ts.csv")).collect())
    assert rows == [("dense", 150, 299), ("freeflow", 0, 150)]


def test_tse_folders_of_different_width(spark, tmp_path):
    """Each folder has its own header; a missing table gives an empty frame."""
    import json

    from roadlens.sources import files as fs

    for name, n in (("a", 3), ("b", 6)):
        (tmp_path / name).mkdir()
        for table in ("speed", "confidence", "cvalue"):
            rows = [f"{t}, " + ", ".join(str(10 * t + j) for j in range(n)) for t in range(2)]
            (tmp_path / name / f"{table}.csv").write_text("time, " + ", ".join(map(str, range(n))) + "\n" + "\n".join(rows) + "\n")
        (tmp_path / name / "segments.json").write_text(json.dumps([500.0 * j for j in range(n)]))
    rows = fs.read_tse(spark, f"{tmp_path}/*").collect()
    assert len(rows) == 2 * (3 + 6)
    assert all(r.avg_speed == 10 * r.t + r.seg_idx and r.seg_start == 500.0 * r.seg_idx and r.cvalue == r.avg_speed for r in rows)
    assert fs.read_tse(spark, f"{tmp_path}/none*").count() == 0
