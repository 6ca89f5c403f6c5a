"""From sentences to ranked relations, through the command line."""

import json

from relweave import cli
from relweave.sources.corpus import write_word2vec


def test_command_line(spark, tmp_path, capsys):
    rows = [f"<ORG>Org{i}</ORG> is based in <LOC>Town{i}</LOC> today ." for i in range(6)] + [f"<ORG>Org{i}</ORG> has offices in <LOC>Town{i}</LOC> ." for i in range(6)] + ["<ORG>Org1</ORG> was sued by <LOC>Town9</LOC> ."]
    (tmp_path / "s.txt").write_text("\n".join(rows))
    (tmp_path / "p.txt").write_text("e1:ORG\ne2:LOC\nOrg0;Town0\nOrg1;Town1\n")
    (tmp_path / "n.txt").write_text("e1:ORG\ne2:LOC\nOrg1;Town9\n")
    (tmp_path / "c.cfg").write_text("min_pattern_support=2\n")
    write_word2vec(str(tmp_path / "v.bin"), {"based": [1.0, 0.1], "offices": [0.9, 0.3], "sued": [-1.0, 0.5]})
    a = ["--config", str(tmp_path / "c.cfg"), "--word2vec", str(tmp_path / "v.bin"), "--sentences", str(tmp_path / "s.txt"), "--positive_seeds", str(tmp_path / "p.txt"), "--negative_seeds", str(tmp_path / "n.txt")]
    a += ["--similarity", "0.6", "--confidence", "0.6", "--iterations", "1", "--output", str(tmp_path / "out"), "--tuples", str(tmp_path / "tuples")]
    assert cli.main(a) == 0
    out = [json.loads(x) for f in sorted((tmp_path / "out").glob("part-*")) for x in f.read_text().splitlines()]
    assert len(out) == 12 and list(out[0]) == ["entity_1", "entity_2", "confidence", "sentence", "bef_words", "bet_words", "aft_words", "passive_voice"]
    assert all(o["confidence"] > 0.9 for o in out) and not any("sued" in o["bet_words"] for o in out)
    # again from the stored tuples
    i = a.index("--sentences")
    a[i : i + 2] = ["--stored", str(tmp_path / "tuples")]
    assert cli.main(a[: a.index("--tuples")]) == 0
    assert "iteration" in capsys.readouterr().out
    assert cli.main([]) == 1
