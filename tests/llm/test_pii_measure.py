"""Personal data in sentences written by hand, unlike those the field learns from: precision and recall of base patterns and field.

``{kind text}`` marks a span; none of these sentences is used in training.
"""
import collections
import re

import numpy as np

from service_insights.llm import pii

HAND = """
Hi Tom, please forward the lease to {email maria.keller+flat@immo-berlin.de} before Friday, thanks!
Contact: {email j_doe99@students.uni.edu}; office hours Mon 10:00-12:00, room 4.112.
Our help desk ({email support@shop.example.org}) answers within 24 hours.
You can write to {email anna (at) riverbank.org} if the form at https://riverbank.org/contact fails.
send patches to {email kernel-list [at] vger.example.net} - no attachments over 100 kB
reach me under {email lucas(at)garage.io} or knock on door 17
Follow @weather_bot for updates; it is not an address, nor is foo@bar.
The commit 3f2a@HEAD~2 broke the build 4.1.2 on 2024-03-11.
Mail goes to {email ops@a.b.c.example}, never to ops@localhost.
The printer sits at {ip 192.168.17.4} and the old one at {ip 10.0.0.250}, both on VLAN 30.
Blocked {ip 203.0.113.77} after 1,204 failed logins in 3.5 hours.
ping {ip 8.8.4.4} works but 300.12.1.9 does not exist and 1.2.3 is a version.
Release 4.12.0.1 is {ip 4.12.0.1} to a pattern, so be it.
Charge it to {card 4111 1111 1111 1111}, expires 11/27, please.
My card {card 5500-0000-0000-0004} was declined twice on 02/03/2025.
Account {card 4012888888881881} is on file since 1998.
The order number 4111 1111 1111 1112 fails the check, as does 1234567812345678.
ISBN 978-3-16-148410-0 and tracking id 9400110200881234567890 are no cards.
Call {phone +49 30 901820} from abroad or ring twice at the door.
Dial {phone +1 (415) 555-2671} ext. 12 after 9 am.
Office: {phone (212) 555-0147}, fax on request.
Text {phone 646-555-0119} when you arrive at gate 22.
Mobile {phone 917.555.0162} or the desk.
Her number is {phone +447911123456}; the PIN is 4482.
Ring {phone (020) 7946-0018} in the evening.
We sold 1,250,000 units in 2019 and 1,310,500 in 2020, up 4.84 %.
Coordinates 52.5200, 13.4050; altitude 34 m; pressure 1013.25 hPa.
The meeting is at 14:30:00 in room 212-555, second floor.
Temperature fell from 21.5 to 9.75 between 6-7 pm on 12-10-2021.
Serial 00-14-22-01-23-45 and part no. 555-0147 were logged.
Section 12.4.1 cites 18 U.S.C. 1030 and 45 CFR 164.514(b).
The score was 3-2, 4-4 and 10-9; attendance 54,321.
Invoice 2023-000871 over 1 499.00 EUR is due in 30 days.
Wire to {email billing@acme-corp.co.uk} or call {phone +44 20 7946 0958}, ref 77-1.
From {ip 172.16.254.1} someone mailed {email root@intra.example.com} at 03:14:15.
Zip 10115, tax id 12/345/67890, blood type 0+, size 42.
Dr. Lee (at) noon, Dr. Wu [at] two; see notes of 5 May.
He ran 42.195 km in 2:58:11, place 117 of 3,482.
"""


def cases():
    out = []
    for line in HAND.strip().split("\n"):
        text, spans, at = "", [], 0
        for m in re.finditer(r"\{(\w+) ([^}]*)\}", line):
            text += line[at:m.start()]
            spans.append((pii.KINDS.index(m.group(1)), len(text), len(text) + len(m.group(2))))
            text += m.group(2)
            at = m.end()
        out.append((text + line[at:], spans))
    return out


def measured(base_only):
    """{kind: (right, found, marked)}."""
    own = cases()
    found = pii.spans([t for t, _ in own], pii.trained())
    out = {}
    for k, kind in enumerate(pii.KINDS):
        got = {(i, s[1], s[2]) for i, spans in enumerate(found) for s in spans if s[0] == k and (s[3] or not base_only)}
        want = {(i, a, b) for i, (_, spans) in enumerate(own) for x, a, b in spans if x == k}
        out[kind] = (len(got & want), len(got), len(want))
    return out


def test_hand_labelled_precision_and_recall():
    base, both = measured(True), measured(False)
    print({"base": base, "with the field": both})
    for kind, (right, found, marked) in both.items():
        assert right >= 0.8 * found and right >= 0.8 * marked, (kind, both)
        assert right >= base[kind][0]
    assert sum(b[0] for b in both.values()) >= sum(b[0] for b in base.values()) + 5


def test_scores_are_the_emissions_of_the_features():
    field = pii.trained()
    words = [w for w, _ in pii.labelled(60, seed=3)] + [["4111", "1111", "1111", "1111", "x"], ["1"]]
    a, mask = field.scores(words)
    b, same = field.emissions([pii.features(w) for w in words])
    assert (mask == same).all() and np.allclose(a[mask], b[mask])
    assert [p.tolist() for p in field.paths(a, mask)] == [p.tolist() for p in field.decode([pii.features(w) for w in words])]


def test_numeric_texts_take_time_in_proportion():
    import time

    field = pii.trained()
    t0 = time.time()
    assert pii.spans(["1 " * 200_000], field) == [[]]
    assert time.time() - t0 < 12
    assert collections.Counter(len(x) for x in pii.spans(["10.0.0.1 " * 3000, "10.0.0.1 x"], field)) == {3000: 1, 1: 1}
