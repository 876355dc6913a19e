from homestream.operators.commands import parse_commands, route_commands

CASES = {
    "Tốc độ quạt 99": ("set_speed", None, 99),
    "tốc độ quạt 100": (None, None, None),
    "tốc độ quạt 0": (None, None, None),
    "tốc độ quạt  lên mức 07 nhé": ("set_speed", None, 7),
    "tốc độ quạt 120 rồi bật quạt": ("on", "fan", None),
    "tốc độ quạt 99999999999999999999999 tắt đèn": ("off", "light", None),
    "tốc độ quạt": (None, None, None),
    "BẬT ĐÈN": ("on", "light", None),
    "tắt quạt và bật quạt": ("on", "fan", None),
    "xin chào": (None, None, None),
    "": (None, None, None),
}


def test_commands(spark):
    df = spark.createDataFrame([(t,) for t in [*CASES, None]], "text string")
    got = {r.text: (r.action, r.target, r.speed) for r in parse_commands(df).collect()}
    assert got == {**CASES, None: (None, None, None)}
    routed = {r.text: (r.feed, r.payload) for r in route_commands(parse_commands(df)).collect()}
    assert routed["Tốc độ quạt 99"] == ("BBC_CONTROL_FAN", "99")
    assert routed["BẬT ĐÈN"] == ("BBC_LED", "1")
    assert routed["tốc độ quạt 99999999999999999999999 tắt đèn"] == ("BBC_LED", "0")
    assert routed["tắt quạt và bật quạt"] == ("BBC_FAN", "1") and len(routed) == 6
