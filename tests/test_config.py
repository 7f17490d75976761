import pytest

from strandwerk.config import check_request, interpolate


def test_interpolate():
    t = {"a": {"b": "x", "c": "${a.b}/y"}, "l": ["${a.c}/${iteration}", 1], "u": "${none}"}
    assert interpolate(t, {"iteration": 3}) == {"a": {"b": "x", "c": "x/y"}, "l": ["x/y/3", 1], "u": "${none}"}
    with pytest.raises(ValueError):
        interpolate({"a": "${b}", "b": "${a}"})


@pytest.mark.parametrize("bad", [{"start": "2024-1-1"}, {"start": "2024-02-01", "end": "2024-01-01"}, {"interval": "hour"}, {"period": "x"}])
def test_bad_requests(bad):
    with pytest.raises(ValueError):
        check_request(**bad)


def test_good_request():
    check_request("2024-01-01", "2024-01-01", "day", "ttm")
