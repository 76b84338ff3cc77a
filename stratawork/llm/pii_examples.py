"""A small table labelled by hand: personal data as people write it, in forms that
the patterns do not know, and numbers that are none.

Spans stand in braces after their kind. All people and numbers are invented; the
cards are the networks' public test numbers.
"""

from __future__ import annotations

import re

MARK = re.compile(r"\{(email|ip|card|phone) ([^{}]*)\}")

EXAMPLES = """\
Call {phone 030 1234 5678} before noon.
Please ring {phone (040) 555 12 34} or write.
My number is {phone (212) 555-0143}, ask for Ann.
Tel. {phone 0171/2345678}
Telefon: {phone 089 / 99 88 77 66}, Mo bis Fr 9 bis 17 Uhr.
Fax {phone 0221-4567890} oder per Post.
mobile {phone 07700 900 123}; leave a message.
Reach the office at {phone 020 7946 0018}.
phone: {phone 555-014-2299}.
Appelez le {phone 01 23 45 67 89} le matin.
Mon portable est le {phone 06 12 34 56 78}, merci.
tél. {phone 04 91 23 45 67} (bureau)
Llame al {phone 912 345 678 00} por la tarde.
Teléfono {phone 0034 612 345 678}
Call me on {phone 0049 30 9876543}, any time.
Dial {phone 001 (415) 555-0199} from abroad.
my cell {phone (646) 555 0177} is always on
Kontakt: {phone (0511) 4433221}, Herr Klein
contact {phone 415.555.0132} for details
Contact: {phone 303.555.0188}.
Rückruf unter {phone 0351 4445566} erbeten.
Handy {phone 0160 99887766}.
Bitte {phone 0201/123456-78} anrufen!
Numéro: {phone 02-40-11-22-33}
Sign up by phone, {phone (800) 555-0100}, or online.
ring {phone 0131 496 0999} and ask for the desk
Call {phone 0161 496 0123} today.
tel {phone (312) 555-0165}
Phone {phone 617-555-0148} after six.
Hotline: {phone 0800 1234567}
Call {phone +44 20 7946 0018} from abroad.
Telefon {phone +49 30 1234567}
phone: {phone +1-212-555-0143}
Pay with {card 4111.1111.1111.1111} please.
Card {card 4012.8888.8888.1881} was declined.
The card number {card 5500.0000.0000.0004} is on file.
Karte {card 5105.1051.0510.5100}, gültig bis 12/29
card: {card 6011.1111.1111.1117}.
Charge {card 5555/5555/5555/4444} for the order.
Kreditkarte {card 4111/1111/1111/1111}
Her card is {card 6011/0009/9013/9424}, she said.
carte {card 4012/8888/8888/1881} expirée
Card no. {card 3782.822463.10005}
Visa {card 4111_1111_1111_1111}
the card {card 5555_5555_5555_4444} again
Card {card 4111  1111  1111  1111} with wide gaps.
Number {card 5105  1051  0510  5100} on the card.
card {card 6011  0000  0000  0004}, thanks
My card is {card 4012 8888 8888 1881}.
Card {card 5555-5555-5555-4444} expired.
tarjeta {card 3566.0020.2036.0505}
tarjeta {card 3566/0020/2036/0505} nueva
Write to {email rené@example.org} soon.
Mail {email anna@müller.example}, please.
E-Mail: {email büro@köln.example}
mailto {email info@bücher.example}
Send it to {email josé@example.net} today.
Contact {email zoë@example.org}.
écrivez à {email rené@exemple.example}
correo {email hola@españa.example}, gracias
An {email info@größe.example} schicken.
mail {email noé@example.fr}!
write {email andré@example.com} now
E-Mail {email post@süß.example} oder Brief
Write to {email anna@example.org} soon.
Mail <{email bob.smith@example.com}>, please.
correo {email josé@ejemplo.example}
contact {email chloé@example.net} for it
The host {ip 192[.]168[.]0[.]1} did not answer.
Server {ip 10[.]0[.]0[.]12} is down.
ping {ip 172[.]16[.]4[.]9} failed
address {ip 192[.]168[.]10[.]77} was blocked
Login from {ip 10[.]20[.]30[.]40} at night.
host {ip 172[.]31[.]255[.]2}, port 22
Server {ip 192.168.0.7} is down.
Login from {ip 10.1.2.3} at night.
Blocked {ip 203[.]0[.]113[.]9} again.
from {ip 198[.]51[.]100[.]23} and others
The invoice of 12.05.2023 lists 17 items.
Between 1998 and 2004 the town grew by 3,500 people.
At 12:30 on 2024-05-06 the train left.
Order 2023-000123 weighs 12.5 kg.
Chapter 3.2.1 follows section 3.1.
Version 10.4.2 of the tool is out.
The price rose from 1,299.00 to 1,349.00 dollars.
ISBN 978-3-16-148410-0 is out of print.
It costs 12 000 000 euros in 2020.
Serial 1234.5678.9012.3456 is printed below.
Part 4111/1111/1111/1112 is out of stock.
Track 1Z 999 AA1 01 2345 6784 is late.
He ran 100 200 400 and 800 metres.
Results: 3 4 5 6 7 8 9 10 11 12.
Room 030, floor 12, desk 34.
Lines 1200 to 1350 of the file changed.
The years 1914 1918 1939 1945 are in the book.
Population 8 336 817 in 2020, 8 804 190 in 2021.
Coordinates 52.5200, 13.4050 mark the place.
Weights of 0,5 and 1,25 and 2,75 kg.
Score 21-19 18-21 21-17 in three sets.
Set values 10, 20, 30, 40 one by one.
The code 123456789012 was scanned 44 times.
Follow us @example or write a note.
See pages 101-120, 133 and 150-166.
Am 3.10.1990 um 0 Uhr begann es.
Sum 1 234 567 890 is large.
The ratio is 16/9 or 4/3, never 21/9.
Kapitel 12 beginnt auf Seite 345.
En 1789 il y avait 28 000 000 d'habitants.
La página 77 tiene 3 errores.
Box 12/34/56/78 stands in row 9.
""".splitlines()


def labelled(lines: list[str] = EXAMPLES) -> list[tuple[str, str]]:
    """Each text without its marks, and its spans as ``pii.find`` writes them."""
    out = []
    for line in lines:
        text, spans, at = "", [], 0
        for m in MARK.finditer(line):
            text += line[at:m.start()]
            spans.append(f"{m[1]}:{len(text)}:{len(text) + len(m[2])}")
            text, at = text + m[2], m.end()
        out.append((text + line[at:], ",".join(spans)))
    return out
