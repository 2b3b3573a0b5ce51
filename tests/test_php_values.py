from sitemigrate.functions.php_values import to_json


def test_back_references():
    assert to_json('a:2:{i:0;s:1:"x";i:1;R:2;}') == '["x","x"]'
    assert to_json('a:2:{i:0;O:8:"stdClass":1:{s:1:"p";i:5;}i:1;r:2;}') == '[{"p":5},{"p":5}]'
    # A copy counts as a value of its own, a reference doesn't: the last one names the third or the fourth value.
    assert to_json('a:4:{i:0;O:1:"A":0:{}i:1;r:2;i:2;s:1:"z";i:3;R:4;}') == '[{},{},"z","z"]'
    assert to_json('a:4:{i:0;a:0:{}i:1;R:2;i:2;s:1:"z";i:3;R:3;}') == '[[],[],"z","z"]'
    assert to_json("a:1:{i:0;R:1;}") == "[null]" and to_json('O:1:"A":1:{s:4:"self";r:1;}') == '{"self":null}'
    assert to_json("a:1:{i:0;R:9;}") is None and to_json("R:1;") is None


def test_any_depth_and_odd_arrays():
    deep = "a:1:{i:0;" * 50_000 + "i:7;" + "}" * 50_000
    assert to_json(deep) == "[" * 50_000 + "7" + "]" * 50_000
    assert to_json('a:3:{s:1:"k";i:1;s:1:"l";a:1:{i:0;i:3;}s:1:"k";i:2;}') == '{"l":[3],"k":2}'
    assert to_json('a:2:{i:1;b:1;i:0;d:0.5;}') == '{"1":true,"0":0.5}' and to_json("a:0:{}") == "[]" and to_json('O:8:"stdClass":0:{}') == "{}"
    assert to_json('s:3:"é";') is None and to_json('s:2:"é";') == '"é"' and to_json("i:1;i:2;") is None and to_json("a:1:{i:0;i:1;") is None and to_json("") is None
