import json

from quernstone.__main__ import main


def test_analyse_from_recorded_pages(spark, tmp_path, monkeypatch, capsys):
    body = "This issue has a body that is long enough to be kept as a record."
    issue = lambda i: {"id": str(i), "number": i, "html_url": f"https://github.com/o/r/issues/{i}", "title": "t", "body": f"{body} {i}", "created_at": f"2024-01-{i + 1:02d}T00:00:00Z", "user": {"id": i}}
    (tmp_path / "o_r.json").write_text("\n".join(json.dumps({"page": p, "items": [issue(4 * p + k) for k in range(4)], "has_next": p < 1}) for p in (0, 1)))
    monkeypatch.setenv("QUERN_SECRET", "ab" * 32)
    run = lambda quota, run_id: main(["analyse", "--source", "github", "--pages", str(tmp_path), "--quotas", json.dumps({"o/r": quota}), "--root", f"file://{tmp_path}/out", "--run-id", run_id, "--secret-env", "QUERN_SECRET", "--collected-at", "2024-05-01T00:00:00Z"])
    assert run(5, "a") == 0 and json.loads(capsys.readouterr().out)["qualified"]
    assert run(50, "b") == 2
    assert json.loads((tmp_path / "out/latest-qualified.json").read_text()) == {"run_id": "a"}
    monkeypatch.setenv("QUERN_SECRET", "ab")
    assert run(5, "c") == 3
