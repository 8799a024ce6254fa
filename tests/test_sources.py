"""Remote sources, case of column names, and the command line."""

import functools
import gzip
import http.server
import json
import sys
import threading
import types

import pytest

from sieveline import cli
from sieveline.plans import audit
from sieveline.plans.config import ConfigError, load
from sieveline.sources.tables import SourceError, download, is_remote, load_pool, parse_hub_url


@pytest.fixture
def site(tmp_path):
    """A folder served over HTTP."""
    folder = tmp_path / "site"
    folder.mkdir()

    class Quiet(http.server.SimpleHTTPRequestHandler):
        def log_message(self, *_):
            pass

        def do_GET(self):
            if "secret" in self.path:
                return self.send_error(401)
            return super().do_GET()

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), functools.partial(Quiet, directory=folder))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield folder, f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_addresses():
    assert is_remote("http://example.org/a.csv") and is_remote("https://example.org/a.csv") and not is_remote("data/a.csv")
    assert parse_hub_url("https://huggingface.co/datasets/org/set/blob/v1.0/file.csv") == ("org/set", "v1.0", "file.csv")
    assert parse_hub_url("https://huggingface.co/org/model/resolve/main/f.csv") is None


def test_remote_files_are_audited_and_dropped(spark, site, tmp_path):
    folder, url = site
    with gzip.open(folder / "train.csv.gz", "wt") as out:
        out.write("SMILES,id\nCCO,007\n")
    (folder / "test.tsv").write_text("SMILES\tid\nOCC\t7\n")
    report = audit.audit(spark, f"{url}/train.csv.gz?download=1", [f"{url}/test.tsv"], identifier_columns=["id"])
    assert report["summary"]["total_exact_leaked_train_molecules"] == 1 and report["config"]["test_files"] == [f"{url}/test.tsv"]
    assert report["train_test_leakage"]["exact"]["inchikey"][0]["train_occurrences"][0]["source_file"] == f"{url}/train.csv.gz?download=1"
    rows, _, _ = load_pool(spark, [f"{url}/train.csv.gz"], "train", "SMILES", ["id"])
    assert rows.first()["raw_identifiers"]["id"] == "007"
    root = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    import os

    assert not [x for x in os.listdir(root) if x.startswith("source-")]
    for path, why in (("none.csv", "no such file"), ("secret.csv", "login")):
        with pytest.raises(SourceError, match=why):
            load_pool(spark, [f"{url}/{path}"], "train", "SMILES", [])


def test_hub_files(monkeypatch, tmp_path):
    asked = {}
    module = types.ModuleType("huggingface_hub")
    monkeypatch.setitem(sys.modules, "huggingface_hub", module)
    url = "https://huggingface.co/datasets/org/set/resolve/main/data/file.csv"
    module.hf_hub_download = lambda **x: asked.update(x) or str(tmp_path / "file.csv")
    assert download(url, tmp_path).name == "file.csv" and asked == {"repo_id": "org/set", "filename": "data/file.csv", "repo_type": "dataset", "revision": "main"}

    class Refused(Exception):
        response = types.SimpleNamespace(status_code=403)

    def refuse(**_):
        raise Refused

    module.hf_hub_download = refuse
    with pytest.raises(SourceError, match="HF_TOKEN"):
        download(url, tmp_path)
    monkeypatch.setitem(sys.modules, "huggingface_hub", None)
    with pytest.raises(SourceError, match="huggingface_hub"):
        download(url, tmp_path)


def test_names_that_differ_in_case(spark, tmp_path):
    (tmp_path / "a.csv").write_text("smi,Id,ID\nCCO,a,b\n")
    rows, seen, resolved = load_pool(spark, [tmp_path / "a.csv"], "train", "SMI", ["ID", "Id"])
    assert rows.first()["raw_identifiers"] == {"ID": "b", "Id": "a"} and list(resolved.values()) == ["smi"] and spark.conf.get("spark.sql.caseSensitive") == "false"
    with pytest.raises(SourceError):
        load_pool(spark, [tmp_path / "a.txt"], "train", "SMILES", [])
    with pytest.raises(FileNotFoundError):
        load_pool(spark, [tmp_path / "none.csv"], "train", "SMILES", [])


def configured(folder, train, test):
    for name, rows in (("train", train), ("test", test)):
        (folder / f"{name}.csv").write_text("SMILES\n" + "".join(f"{x}\n" for x in rows))
    path = folder / "config.toml"
    path.write_text(f"""[paths]\ntrain_files = ["{folder}/train.csv"]\ntest_files = ["{folder}/test.csv"]\nreport_output = "{folder}/out/report.json"\n[columns]\n""")
    return str(path)


@pytest.mark.parametrize(("train", "test", "flags", "status"), [
    (["c1ccccc1CCN"], ["c1ccccc1CCO"], ["--strict"], 0), (["c1ccccc1CCN"] * 2, ["c1ccccc1CCO"], [], 0), (["c1ccccc1CCN"] * 2, ["c1ccccc1CCO"], ["--strict"], 2), (["c1ccccc1CCN"], ["NCCc1ccccc1"], ["-v"], 2),
])
def test_exit_status(spark, tmp_path, capsys, train, test, flags, status):
    assert cli.main([configured(tmp_path, train, test), *flags]) == status
    said = json.loads((tmp_path / "out" / "report.json").read_text())["summary"]["status"]
    assert f"OVERALL {said}" in capsys.readouterr().out


def test_check_on_the_command_line(spark, tmp_path, capsys):
    (tmp_path / "a.csv").write_text("SMILES,id\nCCCCCCCC.OCCCC.Cl,x\nC1CC,y\n")
    out = tmp_path / "r.txt"
    assert cli.main(["check", "--files", str(tmp_path / "a.csv"), "--identifier-columns", "id", "--no-strip-salts", "--multi-component-min-heavy-atoms", "3", "--report-output", str(out)]) == 2
    assert "[FAIL] ring_closure" in out.read_text() and "unparseable" in capsys.readouterr().out
    for bad in (["check"], ["check", "--files", "none.csv"], ["check", "--config", "c.toml", "--files", "a.csv"], ["check", "--nonsense"], [], [str(tmp_path / "nope.toml")], ["check", "--files", "a.csv", "--report-format", "pdf"]):
        assert cli.main(bad) == 1
        assert "rror" in capsys.readouterr().err


@pytest.mark.parametrize("text", [
    "[paths]\n", "[paths]\ntrain_files = []\ntest_files = ['b']\n[columns]\n", "[paths]\ntrain_files = 'a'\ntest_files = ['b']\n[columns]\n", "[paths]\nfiles = ['a']\n[columns]\n", "no toml",
    "[paths]\ntrain_files = ['a']\ntest_files = ['b']\n[columns]\nsmiles_column = 3\n", "[paths]\ntrain_files = ['a']\ntest_files = ['b']\n[columns]\n[settings]\nfp_radius = -1\n",
    "[paths]\ntrain_files = ['a']\ntest_files = ['b']\n[columns]\n[settings]\nstrip_salts = 1\n", "[paths]\ntrain_files = ['a']\ntest_files = ['b']\n[columns]\n[settings]\nodd = 1\n",
])
def test_bad_configurations(tmp_path, text):
    (tmp_path / "c.toml").write_text(text)
    with pytest.raises(ConfigError):
        load(tmp_path / "c.toml", check=False)
