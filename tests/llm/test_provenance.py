import json

from codeloom.llm.provenance import reason, reason_column


def test_cases():
    body = "def f(x):\n    return x\n"
    assert reason("a/b.py", body) is None
    assert reason("a/b.py", "# Code generated by toolx 1.2. DO NOT EDIT.\n" + body) == "generated_notice"
    assert reason("a/b.py", body * 50 + "# @generated by toolx\n") == "generated_notice"
    assert reason("a/b.py", "# This file was created by toolx 3.1. Any change will be lost on the next run.\n" + body) == "generated_notice"
    assert reason("a/b.py", 'BANNER = "Code generated by toolx. DO NOT EDIT."\n' + body) is None
    assert reason("a/b.py", "# parts of the report are generated at run time; see peer\n# do not edit the order by hand\n" + body) is None
    assert reason("a/b.py", "# Copyright 2024 Orrin Works. All rights reserved.\n" + body, ("Orrin Works",)) is None
    assert reason("a/b.py", "# Copyright 2024 Orrin Works. All rights reserved.\n" + body) == "third_party_notice"
    assert reason("a/b.py", "# Copyright 2024 foo authors. All rights reserved.\n" + body) == "third_party_notice"
    assert reason("a/b.py", "# Copied from foo 2.1.0, upstream file b\n" + body) == "third_party_notice"
    assert reason("a/b.py", "# not copied from anywhere\n" + body) is None
    assert reason("a/vendor/foo/b.py", body) == "vendored_path"
    assert {reason(p, body) for p in ("vendor/jquery.js", "node_modules/x.js", "third_party/zlib.c", "a/vendor/lib.go")} == {"vendored_path"}
    assert reason("vendor", body) is None and reason("a/vendor.py", body) is None
    assert reason("a/vendor_portal/foo/b.py", body) is None
    assert reason("a/package-lock.json", "{}") == "lock_file"
    assert reason("a/x.js", "function a(b,c){return b?c.d(e):!1};" * 40) == "minified"
    assert reason("a/x.json", "[" + ",".join(f'{{"row": {i}, "v": 0.{i}}}' for i in range(60)) + "]") == "literal_data"
    assert reason("a/x.py", "T = [\n" + "".join(f"    ({i}, 1.5, 'w'),\n" for i in range(40)) + "]\n") == "literal_data"
    assert reason("a/x.py", "class A:\n" + "".join(f"    def get_x{i}(self):\n        return self._fields[{i}]\n\n" for i in range(9))) == "numbered_members"


def test_edges():
    assert reason(None, None) is None and reason("a/package-lock.json", "") is None and reason("x.py", " \n") is None
    assert reason("a/vendor/foo/b.js", "<!DOCTYPE html>\n<html></html>") is None
    assert reason(None, "# @generated by x\n") == "generated_notice"
    assert reason("a.py", "x = 1\n" * 300_000 + "# @generated\n") == "generated_notice"
    assert reason("İ.py", "# İİ\n# @generated\n") == "generated_notice"


def test_column(spark):
    df = spark.createDataFrame([("a.py", "# @generated\n"), ("a.py", "# @generated\n"), (None, None)], "path string, content string")
    assert [r[0] for r in df.select(reason_column("path", "content")).collect()] == ["generated_notice"] * 2 + [None]
    assert df.limit(0).select(reason_column("path", "content")).count() == 0


def test_json_arrays_under_any_keys():
    many = list(range(1000))
    shapes = [{"values": many}, {"type": "Polygon", "coordinates": [[[x, x / 7] for x in many]]}, {f"column{i}": many[i : i + 40] for i in range(30)}, {f"k{i}": i * 0.5 for i in many}]
    assert [reason("a/b.json", json.dumps(x, indent=2)) for x in shapes] == ["literal_data"] * 4
    config = {f"rule{i}": {"level": "error", f"option{i}": ["a", "b", i]} for i in range(60)}
    assert reason("a/b.json", json.dumps(config, indent=2)) is None
