"""Payload files: bad records and files are counted and set aside, good ones beside them are read."""

from tidemark.sources import files as SF
from tidemark.sources import payloads as P

GOOD = "<ownershipDocument><issuer><issuerCik>00{}</issuerCik></issuer><nonDerivativeTable><nonDerivativeTransaction><transactionDate><value>2024-01-0{}</value></transactionDate></nonDerivativeTransaction></nonDerivativeTable></ownershipDocument>"


def test_bad_records_do_not_take_their_neighbours(spark, tmp_path):
    bad = GOOD.format(9, 9).replace("</issuerCik>", "</issuer>")
    for name, docs in {"a": [GOOD.format(1, 1), bad, GOOD.format(2, 2), bad, GOOD.format(3, 3)], "b": [bad, GOOD.format(4, 4)], "c": []}.items():
        (tmp_path / f"{name}.xml").write_text("\n".join(docs))
    rows = SF.xml_records(spark, str(tmp_path), "ownershipDocument", P.OWNERSHIP)
    assert sorted(map(tuple, SF.quarantine(rows, ["file"]).collect())) == [("a.xml", 5, 2), ("b.xml", 2, 1)]
    assert sorted(r.event_date.day for r in P.transactions(SF.sound(rows), ["file"]).collect()) == [1, 2, 3, 4]
    assert all("ownershipDocument" in r.malformed for r in rows.where("malformed IS NOT NULL").collect())


def test_torn_calendars_are_set_aside(spark, tmp_path):
    event = "BEGIN:VEVENT\r\nUID:{}\r\nDTSTART:20240105T083000Z\r\nSUMMARY:x\r\nEND:VEVENT\r\n"
    (tmp_path / "good.ics").write_text("BEGIN:VCALENDAR\r\n" + event.format(1) + event.format(2) + "END:VCALENDAR\r\n", newline="")
    (tmp_path / "torn.ics").write_text(event.format(3) + event.format(4)[:-14], newline="")
    (tmp_path / "page.ics").write_text("<html>not found</html>")
    rows = SF.whole_texts(spark, str(tmp_path), "BEGIN:VEVENT", "END:VEVENT")
    assert sorted((r.file.rsplit("/", 1)[1], r.records, r.malformed) for r in SF.quarantine(rows, ["file"]).collect()) == [("good.ics", 1, 0), ("page.ics", 1, 1), ("torn.ics", 1, 1)]
    assert sorted(r.uid for r in P.calendar_events(SF.sound(rows), ["file"], "body").collect()) == ["1", "2"]
