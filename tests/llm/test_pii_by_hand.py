"""The tagger on lines written by hand, none of them from its own generator."""

import pytest

from mainswatt.llm import pii, spans

LINES = [
    ("my phone is 555-123-4567.", ["phone:555-123-4567"]),
    ("write to john.smith at example dot com", ["email:john.smith at example dot com"]),
    ("a.b{at}c.org is mine", ["email:a.b{at}c.org"]),
    ("Please call (212) 555-0187 before noon", ["phone:(212) 555-0187"]),
    ("Fax: 0161 496 0000", ["phone:0161 496 0000"]),
    ("my mail: maria_lopez [at] posteo [dot] de", ["email:maria_lopez [at] posteo [dot] de"]),
    ("reach me under sales@shop.example.com", ["email:sales@shop.example.com"]),
    ("server 192[.]168[.]0[.]12 was down", ["ip:192[.]168[.]0[.]12"]),
    ("host 10(.)0(.)0(.)7 answered", ["ip:10(.)0(.)0(.)7"]),
    ("card 4111.1111.1111.1111 expired", ["card:4111.1111.1111.1111"]),
    ("cards 4111111111111111 5500005555555559 both", ["card:4111111111111111", "card:5500005555555559"]),
    ("dial 312.555.0142 for help", ["phone:312.555.0142"]),
    ("ring 415-555-2671 or 415-555-2672 today", ["phone:415-555-2671", "phone:415-555-2672"]),
    ("Bob (bob77 at mail dot org) wrote", ["email:bob77 at mail dot org"]),
    ("mail info(at)verein.org please", ["email:info(at)verein.org"]),
    ("tel. +49 30 1234567", ["phone:+49 30 1234567"]),
    ("the address 8.8.8.8 is public", ["ip:8.8.8.8"]),
    ("peter.parker AT dailynews DOT net", ["email:peter.parker AT dailynews DOT net"]),
    ("contact: hans-peter[at]firma[dot]com now", ["email:hans-peter[at]firma[dot]com"]),
    ("our office (020) 7946 0958 London", ["phone:(020) 7946 0958"]),
    ("Tel: 0221 555 1234", ["phone:0221 555 1234"]),
    ("fax (0711) 2345 6789, ask for Eva", ["phone:(0711) 2345 6789"]),
    ("sms 646-555-0199!", ["phone:646-555-0199"]),
    ("you may email anna.schmidt at web dot de today", ["email:anna.schmidt at web dot de"]),
    ("(contact lee_92(at)mail(dot)org)", ["email:lee_92(at)mail(dot)org"]),
    ("<tom@host.net>", ["email:tom@host.net"]),
    ("gateway=172[.]16[.]4[.]254;", ["ip:172[.]16[.]4[.]254"]),
    ("pay by 5500.0055.5555.5559 or cash", ["card:5500.0055.5555.5559"]),
    ("call 1-800-555-0123 now", ["phone:1-800-555-0123"]),
    ("Mobile 0171 234 5678\nHome 030 123 4567", ["phone:0171 234 5678", "phone:030 123 4567"]),
    ("k.lee {at} univ {dot} edu", ["email:k.lee {at} univ {dot} edu"]),
    ("ping 1.1.1.1 first", ["ip:1.1.1.1"]),
    ("numbers: 212.555.0188, 212.555.0189", ["phone:212.555.0188", "phone:212.555.0189"]),
    ("maria AT posta DOT it wrote back", ["email:maria AT posta DOT it"]),
    ("my card is 4012-8888-8888-1881.", ["card:4012-8888-8888-1881"]),
    ("Durchwahl: (089) 5501 2233", ["phone:(089) 5501 2233"]),
    ("whatsapp 718-555-0147?", ["phone:718-555-0147"]),
    ("ask otto.weber at firma dot net", ["email:otto.weber at firma dot net"]),
    ("{nina-k[at]post[dot]info}", ["email:nina-k[at]post[dot]info"]),
    ("ip: 10[.]20[.]30[.]40", ["ip:10[.]20[.]30[.]40"]),
    ("visa 4012.8888.8888.1881 ok", ["card:4012.8888.8888.1881"]),
    ("Call me at 0151 987 6543 or at work", ["phone:0151 987 6543"]),
    ("fred AT zoo DOT org, please", ["email:fred AT zoo DOT org"]),
    ("4111111111111111 4012888888881881", ["card:4111111111111111", "card:4012888888881881"]),
    ("mail eva@uni.edu now", ["email:eva@uni.edu"]),
    ("support (at) shop (dot) com", ["email:support (at) shop (dot) com"]),
    ("+44 20 7946 0991", ["phone:+44 20 7946 0991"]),
    *[(x, []) for x in (
        "the sums 120 300 450 and 700 units", "1 2 3 4 5 6 7 8 9 10 11 12", "ISBN 978-3-16-148410-0 in print", "ISBN 0-306-40615-2", "order number 123-456-7890-11 shipped",
        "invoice 2024-0011-5567 is due", "the years 1990 1995 2000 and 2005", "version 1.2.3.4567 released", "meet at 5 or at 6 pm", "section 12.3.4 and 12.3.5",
        "pi is 3.14159265358979", "population 1,234,567 on 2020-05-17", "range 100-200-300-400", "ratio 16:9 at 1920x1080", "scores 21-19 21-18 19-21",
        "lat 48.137154 lon 11.576124", "part no. 4711-0815-22", "look at that dot on the map", "0800 to 1600 hours, room 12-034", "grid 10 20 30 40 50 60 70 80",
        "ISBN-13: 979-8-6024-0545-3", "ids 4021 4022 4023 4024", "chapters 1, 2, 3 and 10 at the end", "invoice no. 887-221-0042-17", "from 1914 to 1918 and 1939-1945",
        "add 250 g flour, 125 ml milk", "the 100 200 300 400 m races", "at noon we dot the line", "lottery 03 11 19 27 33 45", "budget 1.250.000 in 2019",
        "bus 12-34-56 leaves at 07:45", "page 1200 of 3400", "version 10.4.22-rc1", "size 120 x 80 x 40", "tracking 9400 1000 0000 0000 00",
        "we sat at a table dot by dot", "isbn 0-19-853453-1", "codes 5511 6622 7733", "rooms 101-102-103", "temps 12.5 13.1 14.2",
        "1024 2048 4096 8192", "SKU 555-0001-22-9", "look at this dot com era joke", "on 03.04.2021 at 10:30", "win 6-4 3-6 7-5",
        "it cost 12,500.00 in all", "born 1999-12-31",
    )],
]


@pytest.fixture(scope="module")
def trained():
    """With the steps that the query takes."""
    return pii.Tagger().train(*pii.training_set([]))


def tagged(model, text):
    base, parts = spans.personal(text), pii.stretches(text)
    found = base + pii.added(text, base, parts, pii.decode(model, [text[s:e] for s, e in parts]))
    return {f"{kind}:{text[s:e]}" for kind, s, e in found}


@pytest.mark.parametrize(("text", "good"), [
    ("120 300 450", False), ("978-3-16-148410-0", False), ("0-306-40615-2", False), ("123-456-7890-11", False), ("21-19 21-18 19-21", False), ("2024-05-17", False), ("10.20.30.4000", False),
    ("555-123-4567", True), ("(020) 7946 0958", True), ("01 23 45 67 89", True), ("+1 20 30 40 50", True),
])
def test_phone_shapes(text, good):
    assert pii.plausible("phone", text) == good


def test_lines_written_by_hand(trained):
    wanted = found = right = 0
    for text, want in LINES:
        got = tagged(trained, text)
        wanted, found, right = wanted + len(want), found + len(got), right + len(got & set(want))
    assert right / wanted >= 0.9 and right / found >= 0.9
