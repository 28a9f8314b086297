import json

from accordant import cli


def test_replay_of_three_tracks(spark, tmp_path, capsys):
    # interleaved tracks; one has a single channel
    lines = [{"track_id": t, "timestamp_ms": 100 * s, "seq": s, "modality": m, "nis": 3.0, "dof": 3} for s in (1, 2) for t, mods in ((20, ("radar", "visual")), (10, ("visual",)), (30, ("radar", "visual"))) for m in mods]
    (tmp_path / "r.jsonl").write_text("".join(json.dumps(x) + "\n" for x in lines))
    cli.main(["replay", str(tmp_path / "r.jsonl"), "--tracks", "1"])
    out = capsys.readouterr().out
    assert "track 10: baseline insufficient, default insufficient" in out and "no positive alarm frames; insufficient-evidence 2 frame(s), first seq 1, last seq 2" in out
    assert "2 more track(s): 0 with alarms, 2 with insufficient evidence" in out


def test_sparkline():
    assert cli.sparkline([]) == "" and cli.sparkline([1, 1]) == "▁▁" and cli.sparkline([0, 1]) == "▁█" and len(cli.sparkline(list(range(1000)))) == 48
