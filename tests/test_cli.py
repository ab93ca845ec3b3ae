import pytest

from chunkwell import cli


def test_usage_errors_exit_2():
    for wrong in ([], ["nothing"], ["commit"], ["checkout"]):
        with pytest.raises(SystemExit) as e:
            cli.parser().parse_args(wrong)
        assert e.value.code == 2


def test_commands(spark, tmp_path, capsys):
    (tmp_path / "a.txt").write_bytes(b"hello world")
    call = lambda *args: cli.run(cli.parser().parse_args(["--root", str(tmp_path), *args]), spark)
    with pytest.raises(FileNotFoundError):
        call("log")
    assert call("init") == 0 and call("add", "a.txt") == 0 and call("commit", "-m", "first") == 0
    commit = capsys.readouterr().out.split()[-1]
    assert len(commit) == 64 and call("log") == 0 and commit[:12] in capsys.readouterr().out
    (tmp_path / "a.txt").write_bytes(b"changed")
    assert call("checkout", commit[:8]) == 0 and (tmp_path / "a.txt").read_bytes() == b"hello world"
    assert call("fsck") == 0 and call("gc", "--dry-run") == 0 and call("branch") == 0 and call("rm", "a.txt") == 0
    assert call("push", str(tmp_path / "remote")) == 0 and call("pull", str(tmp_path / "remote")) == 0
