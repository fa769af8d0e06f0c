import random

import pytest

from dasymetra.sources.delimited import FEEDS, check_line, loaded_rows, parse_lines

GOOD = "2020;123;07; 1010;CRECHE;-9.5;-50.25"


@pytest.mark.parametrize("line, reason", [
    (GOOD, None), ('"2020";"123";"7";"1010";"A ""B""; C";"";""', None), ('2020;1;1;1;"a\nb";1;1', None), ("2020;1;1;1;;;", None), (None, "null_line"), ("", "blank_line"), ("   ", "blank_line"),
    ('2020;1;1;1;"open;1;1', "quote_not_closed"), ('2020;1;1;1;"a"b;1;1', "text_after_closing_quote"), ('2020;1;1;1;a"b;1;1', "quote_inside_field"), ('2020;1;1;1; "a";1;1', "quote_inside_field"),
    ("2020;1;1;1;a;1", "too_few_fields"), (GOOD + ";x", "too_many_fields"), ("2020|1|1|1|a|1|1", "too_few_fields"), ("2020;1;0;1;a;1;1", "out_of_range"), ("2020;1;10000;1;a;1;1", "out_of_range"),
    ("2020;1;１２;1;a;1;1", "not_a_whole_number"), ("2020;1;+5;1;a;1;1", "not_a_whole_number"), (";1;1;1;a;1;1", "missing"), ("2020;1;1;1;a;90.0001;1", "out_of_range"), ("2020;1;1;1;a;−9;1", "not_a_decimal"),
    ("2020;1;1;1;a;3e1;1", "not_a_decimal"), ("2020;1;1;1;a;.5;1", "not_a_decimal"), ("2020;1;1;2147483648;a;1;1", "out_of_range"), ("2020;1;1;1;a\rb;1;1", "line_break_outside_quotes"),
])
def test_each_fault_has_its_reason(line, reason):
    fields, found, _ = check_line(line, FEEDS["geocode_locs"])
    assert found == reason
    assert (fields is None) == (reason is not None)


def test_rejected_field_is_named():
    assert check_line("2020;3;1;1;1;1;1;1;1", FEEDS["merged"])[1:] == ("out_of_range", "nr_turno")


def test_very_long_line():
    assert check_line('2020;1;1;1;"' + "x;" * 1_000_000 + '";1;1', FEEDS["geocode_locs"])[1] is None


def _by_hand(line):
    """A reader of its own kind: character by character."""
    fields, at = [], 0
    while True:
        if line[at : at + 1] == '"':
            at += 1
            out = ""
            while True:
                if at >= len(line):
                    return None
                if line[at] == '"':
                    if line[at + 1 : at + 2] == '"':
                        out, at = out + '"', at + 2
                        continue
                    at += 1
                    break
                out, at = out + line[at], at + 1
            fields.append(out)
            if at < len(line) and line[at] != ";":
                return None
        else:
            end = line.find(";", at)
            end = len(line) if end < 0 else end
            if '"' in line[at:end]:
                return None
            fields.append(line[at:end])
            at = end
        if at >= len(line):
            return fields
        at += 1


def test_structure_against_a_reader_by_hand():
    from dasymetra.sources.delimited import split_record

    rnd = random.Random(5)
    for _ in range(20_000):
        line = "".join(rnd.choice('";"ab ;') for _ in range(rnd.randint(1, 14)))
        assert split_record(line, ";")[0] == _by_hand(line), line


def test_loading_keeps_every_row_once(spark):
    rows = [(1, "geocode_locs", GOOD, "a"), (1, "geocode_locs", GOOD, "a"), (2, None, GOOD, None), (3, "other", GOOD, "b"), (4, "geocode_locs", None, "c"), (None, "geocode_locs", "x", "d")]
    lines = spark.createDataFrame(rows, "line_id bigint, feed string, line string, reason string")
    out = parse_lines(lines)
    assert out.columns == ["line_id", "feed", "line", "reason", "fields", "reason_", "at_field"]
    assert sorted((r.line_id or 0, r.reason_) for r in out.collect() if r.reason_) == [(0, "too_few_fields"), (2, "unknown_feed"), (3, "unknown_feed"), (4, "null_line")]
    loaded = loaded_rows(out, FEEDS["geocode_locs"], ["line_id"]).collect()
    assert [(r.line_id, r.ano, r.nr_zona, r.lat, r.nm_local) for r in loaded] == [(1, 2020, 7, -9.5, "CRECHE")] * 2
    assert parse_lines(lines.limit(0)).count() == 0
