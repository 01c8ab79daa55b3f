"""Texts written by hand, apart from the training generator. <e>email</e> <p>phone</p> <i>national id</i> <a>address</a> <n>name</n>."""

import re

TEXTS = """My social security number is <i>078-05-1120</i>.
His number is <p>555-867-5309</p>, leave a message.
New York City hosted the United Nations General Assembly.
Yesterday <n>Barack Obama</n> met <n>Angela Merkel</n> in Berlin.
Kind regards,\\n<n>Jennifer Lawrence</n>\\nSenior Engineer
Invoice 2024-03-1123 is overdue.
The president lives at <a>1600 Pennsylvania Avenue NW, Washington</a>.
Ship it to <a>12 Main St.\\nSpringfield QX21 1DQ</a>
Please forward it to <e>jane.doe@gmail.com</e> or call <p>(212) 555-0187</p>.
Der Brief ging an <n>Hans Müller</n>, <a>Bahnhofstraße 5, 10115 Berlin</a>.
La doctora <n>García</n> atendió a <n>Pedro Sánchez López</n>.
The Supreme Court ruled on Monday.
I met Mark at the summer party in April.
You can write to <e>mary (at) example (dot) org</e> about the flat.
Passport number <i>C01X00T47</i> was found in the taxi.
Call the front desk on <p>+44 20 7946 0958</p> after six.
<n>Susan B. Anthony</n> was born in Adams, Massachusetts.
Version 10.2.33.1 was released on 2023-11-02.
The meeting moved to room 204-33.
Send the contract to Dr. <n>Emily Watson</n>.
Mrs <n>Robinson</n> keeps the spare key.
Our server at 192.168.0.17 dropped 120 450 1200 bytes.
Frau <n>Schmidt</n> wohnt in der <a>Lindenallee 12a, 80331 München</a>.
Meine Steuer-ID lautet <i>12 345 678 901</i>.
Mi DNI es <i>12345678Z</i> y vivo en la <a>Calle de Alcalá 45, 3.º B, 28014 Madrid</a>.
Llame al <p>+34 612 34 56 78</p> por la tarde.
git@github.com:torvalds/linux.git is the remote.
Install left-pad@1.3.0 and restart.
The White House denied it.
<n>O'Brien, Patrick</n> signed in at 09:14.
Forward all complaints to <e>complaints+uk@big-shop.co.uk</e>!
Reach <n>Nguyen Thi Lan</n> at <e>lan.nguyen@vnmail.vn</e>.
She left the parcel at <a>7 Orchard Close, Bath BA2 4QX</a>.
Tax number <i>536-22-8726</i> belongs to the estate.
Order 536-22-87 was shipped twice.
The Johnson & Johnson report was late.
<n>Johannes van der Berg</n> and <n>Aisha Khan</n> won the bid.
Thanks, Peter
The Rose Garden opens in May.
Grace asked for hope and joy.
Fax: <p>030/901820-55</p>
<p>07911 123456</p> is my new mobile.
Ticket ABC-123-456-7890 is closed.
Window 555-4021 is broken.
NHS number <i>943 476 5919</i> is on the form.
Author: <n>Ada Lovelace</n> <<e>ada@analytical.engine.org</e>>
{"user": "<n>Tom Becker</n>", "mail": "<e>tom.becker@firma.de</e>"}
The quick brown fox jumps over the lazy dog.
Lines 210-455 of the file are generated.
El señor <n>Gómez</n> no contesta.
Quarterly Report of the Central Bank
Der Vorsitzende <n>Karl-Heinz Brandt</n> trat zurück.
Mr <n>Holmes</n> and Dr. <n>Watson</n> took the train.
Professor Pixel is our mascot.
Deliver to <a>350 Fifth Avenue, New York, NY 10118</a>, attention <n>Laura Kim</n>.
My driver's licence <i>D123-4567-8901</i> expired.
<n>m. curie</n> discovered radium.
The score was 3-2 after 90 minutes."""


def marked(line: str) -> tuple[str, set[tuple[int, int, int]]]:
    """The text without marks, and its spans (kind, start, end)."""
    out, spans, at = "", set(), 0
    for m in re.finditer(r"<([epian])>(.*?)</\1>", line, re.S):
        out += line[at : m.start()]
        spans.add(("epian".index(m[1]), len(out), len(out) + len(m[2])))
        out += m[2]
        at = m.end()
    return out + line[at:], spans


def cases() -> list[tuple[str, set[tuple[int, int, int]]]]:
    return [marked(x.replace("\\n", "\n")) for x in TEXTS.splitlines()]
