import json

import pytest

from graphloom.sources import governance


def test_presets_parse():
    for name in governance.PRESETS:
        found = governance.parse(governance.preset(name))
        assert found.gates["min_health"] == 80 and "dist/**" in found.config.ignore_paths
    assert governance.parse(governance.preset("node-api")).config.boundaries[0].kinds == ["IMPORTS", "CALLS"]
    with pytest.raises(ValueError):
        governance.preset("none")


def test_load(spark, tmp_path):
    assert governance.load(spark, str(tmp_path)).gates == {}
    document = {"boundaries": {"groups": {"a": "x/**", "b": {"paths": ["y/**"]}}, "rules": [{"from": "a", "to": ["b"], "type": "permit"}]}, "publicApi": ["lib/x.ts#run", "Component:1", "src/**"], "ci": {"gates": {"minCoveragePct": 50}}}
    (tmp_path / ".graphloom.json").write_text(json.dumps(document))
    found = governance.load(spark, str(tmp_path))
    assert found.config.groups == {"a": ["x/**"], "b": ["y/**"]} and found.config.boundaries[0].allow and found.gates == {"min_coverage": 50}
    assert [(list(p.paths), list(p.names), list(p.ids)) for p in found.config.public_api] == [(["lib/x.ts"], ["run"], []), ([], [], ["Component:1"]), (["src/**"], [], [])]
    for odd in ({"ci": {"gates": {"other": 1}}}, {"publicApi": [{"names": ["x"]}]}, {"boundaries": {"rules": [{"from": 1, "to": "a"}]}}):
        with pytest.raises(ValueError):
            governance.parse(odd)
