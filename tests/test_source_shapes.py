"""Adapters of whole pages: sales under headings, cards with places, genres or towns, and seasons."""

import datetime as dt

from pyspark.sql import functions as F

from agendula.operators import sequences
from agendula.sources import adapters as A

from .test_sources import AS_OF, day, raw


def test_sale_listing(spark):
    page = """<div class="ev-section"><h2>Samedi 18 juillet 2026</h2>
      <div class="c"><a href="/06/nice/123-x"><img></a><a href="/06/nice/123-x">Nice Brocante de la place</a><p>06300 - Brocante - Place Garibaldi</p></div>
      <li><a href="/06/saint-laurent-du-var/7-y">Grand déballage</a> <p>•• 06700 - Vide-Grenier</p></li></div>
      <div class="ev-section"><h2>Dimanche 19 juillet 2026</h2><div><a href="/06/nice/123-x">Nice Brocante de la place</a><p>environ 120</p></div></div>
      <a href="/06/nice/">all</a><div><a href="/83/toulon/9-z">Toulon</a></div>"""
    got = A.sale_listing(raw(spark, page), AS_OF, base="https://b").orderBy("pos").collect()
    assert [(r.title, r.start, r.town, r.venue, r.url) for r in got] == [
        ("Brocante de la place", day(18), "Nice", "Place Garibaldi", "https://b/06/nice/123-x"), ("Grand déballage", day(18), "Saint Laurent Du Var", None, "https://b/06/saint-laurent-du-var/7-y"), ("Brocante de la place", day(19), "Nice", None, "https://b/06/nice/123-x")]
    assert [r.note for r in got] == ["Brocante", "Vide-grenier · medium-sized market", "Vide-grenier · ~120 exhibitors"]


def test_place_cards(spark):
    card = """<div class="event-item__wrap"><div><a class="event-item__title-link" href="{h}">{t}</a></div><ul><li><time datetime="2026-07-18">a</time></li><li><time datetime="{e}">b</time><time datetime="21:00">c</time></li></ul>
      <div class="time-place__item is-place">Lieu : {p}</div><a class="event-item__category">Les Soirées Estivales,</a><a class="event-item__category">Accessible PMR</a><a class="event-item__category">Jazz</a></div>"""
    page = card.format(h="/e/1", t="Trio", e="2026-07-18", p="Lucéram") + card.format(h="/e/2", t="Nuit", e="2026-07-20", p="Vence - Salle X") + card.format(h="/e/1", t="Trio", e="2026-07-18", p="") + card.format(h="/e/3", t="Réunion publique", e="2026-07-18", p="") + '<div class="event-item__wrap"><a class="event-item__title-link" href="/e/4">No day</a></div>'
    got = A.place_cards(raw(spark, page), AS_OF, base="https://d").orderBy("pos").collect()
    assert [(r.title, r.start, r.end, r.time, r.town, r.venue, r.url, r.note, r.free) for r in got] == [
        ("Trio", day(18), None, "21:00", "Lucéram", "Lucéram", "https://d/e/1", "Les Soirées Estivales · Jazz", True), ("Nuit", day(18), day(20), "21:00", "Vence", "Vence - Salle X", "https://d/e/2", "Les Soirées Estivales · Jazz", True)]
    assert got[0].category == "concert"


def test_genre_cards(spark):
    card = '<a href="/evenement/{n}?x=1"><img alt="{a}"></a><a href="/evenement/{n}/"><div class="info-container"><img alt="{a}"><h2>Head {n}…</h2><span class="date">{d}</span><p class="lieu">{v}</p><p class="genre">{g}</p></div></a>'
    page = card.format(n=1, a="Le Cid…", d="Du 18/07/2026 au 20/07/2026", v="TNN", g="Théâtre") + card.format(n=2, a="", d="19/07/2026", v="Théâtre de l'Alphabet", g="Jazz") + card.format(n=3, a="Duo", d="21/07/2026", v="Alphabet", g="Danse / hip-hop") + card.format(n=4, a="None", d="", v="TNN", g="")
    rows = lambda **k: [(r.title, r.start, r.end, r.venue, r.category, r.url) for r in A.genre_cards(raw(spark, page), AS_OF, base="https://t", **k).orderBy("pos").collect()]
    cid = ("Le Cid", day(18), day(20), "TNN", "scene", "https://t/evenement/1")
    two, three = ("Head 2", day(19), None, "Théâtre de l'Alphabet", "concert", "https://t/evenement/2"), ("Duo", day(21), None, "Alphabet", "danse", "https://t/evenement/3")
    listed = spark.createDataFrame([("/evenement/2/?y=1",)], "href string")
    assert rows() == [cid, two, three] and rows(restricted="alphabet") == [cid]
    assert rows(restricted="alphabet", excluded=listed) == [cid, three] and rows(restricted="alphabet", excluded=listed.where("false")) == [cid, two, three]


def test_town_cards(spark):
    card = '<div><p>18/07/2026 20h30</p><div><div><a href="/event/{n}">{t}</a></div><span>{p}</span></div></div>'
    page = "<main>" + card.format(n=1, t="Fest", p="Saint-Martin-Vésubie, place") + card.format(n=2, t="No town", p="nowhere") + card.format(n=3, t="x", p="Nice") + "<p>" + "long " * 1500 + "</p></main>"
    details = spark.createDataFrame([("/event/1", "Salle", "21:00", "about")], "url string, venue string, time string, note string")
    got = A.town_cards(raw(spark, page), AS_OF, details=details).collect()
    assert [(r.title, r.start, r.town, r.venue, r.time, r.url, r.note) for r in got] == [("Fest", day(18), "Saint-Martin-Vésubie", "Salle", "21:00", "/event/1", "about")]


def test_season_programme_rolls_over_the_year(spark):
    card = '<li class="card"><a class="card__link" href="/saison/{s}/x"><span class="card__spectacle_title">{t}</span></a><p class="card__dates">{d}</p><p class="card__description">About</p></li>'
    page = '<span class="enveloppe__number">2026</span>' + card.format(s="musique-live", t="Fin", d="30 et 31 décembre. 1er et 2 janvier") + card.format(s="autre", t="Oct", d="du 10 au 12 octobre à 20 h") + '<span class="enveloppe__number">2027</span>' + card.format(s="danse", t="Mars", d="3 et 17 avril. 22 mai")
    got = A.season_programme(raw(spark, page), AS_OF, base="https://a", town="Antibes", venue="V").orderBy("pos").collect()
    d = dt.date
    assert [r.start for r in got if r.title == "Fin"] == [d(2026, 12, 30), d(2026, 12, 31), d(2027, 1, 1), d(2027, 1, 2)]
    assert [r.start for r in got if r.title == "Oct"] == [d(2026, 10, n) for n in (10, 11, 12)] and [r.start for r in got if r.title == "Mars"] == [d(2027, 4, 3), d(2027, 4, 17), d(2027, 5, 22)]
    assert {(r.title, r.category) for r in got} == {("Fin", "concert"), ("Oct", "scene"), ("Mars", "danse")} and got[0].url == "https://a/saison/musique-live/x" and got[0].note == "About"
    assert spark.range(1).select(sequences.rolled_years(F.array(*map(F.lit, [11, 12, 1, 3, 2])))).first()[0] == [0, 0, 1, 1, 2]


def test_templated_table(spark):
    body = '{"start":"2026-07-18","act":"Trio","slot":"20h","extra":"quiz"}\n{"start":"2026-07-19","act":"Duo","slot":"21h"}\n{"start":"soon","act":"Solo"}\nbroken\n'
    got = A.templated_table(raw(spark, body), AS_OF, title="Nights — {act}", note="Free · concert {slot}", town="Nice", venue="Hall", url="https://n/{act}/", category="concert", free=True).orderBy("pos").collect()
    assert [(r.title, r.start, r.note, r.town, r.venue, r.url, r.category, r.free) for r in got] == [("Nights — Trio", day(18), "Free · concert 20h", "Nice", "Hall", "https://n/Trio/", "concert", True), ("Nights — Duo", day(19), "Free · concert 21h", "Nice", "Hall", "https://n/Duo/", "concert", True)]
    body = '{"start":"2026-07-18","title":"Jazz night","town":"Nice","venue":"","price":"20 €","free":"false"}\n{"start":"2026-07-18","title":"Show","town":"Nice","venue":"V","price":"","free":"true"}'
    got = A.templated_table(raw(spark, body), AS_OF, note="{price}").orderBy("pos").collect()
    assert [(r.title, r.venue, r.note, r.free, r.url) for r in got] == [("Jazz night", None, "20 €", False, None), ("Show", "V", None, True, None)]


def test_pages_without_cards_give_nothing(spark):
    for f in (A.sale_listing, A.place_cards, A.genre_cards, A.town_cards, A.season_programme):
        assert f(raw(spark, "", "plain", "<p>x</p>"), AS_OF).count() == 0 and f(raw(spark, "x").where("false"), AS_OF).count() == 0


def test_dance_table(spark):
    page = "<h3>Samedi 18 juillet 2026</h3><table><tr><td>21:00</td><td>x</td><td>Amarras 2 rue la Bruyere 06000 Nice from 9pm to 1:30am 10 euros / 8 euros DJ: Ana B</td></tr><tr><td>20h</td><td>Milonga libre au chapeau</td></tr><tr><td></td><td></td></tr></table><h3>Dimanche 19 juillet 2026</h3><table><tr><td>19h30</td><td>Milonga libre</td></tr></table>"
    got = A.dance_table(raw(spark, page), AS_OF).orderBy("pos").collect()
    assert [(r.title, r.start, r.time, r.town, r.venue, r.price, r.free) for r in got] == [
        ("Amarras", day(18), "21:00", "Nice", "2 rue la Bruyere · 06000", "10 euros / 8 euros", False), ("Milonga libre au chapeau", day(18), "20:00", "Nice", None, "au chapeau", True), ("Milonga libre", day(19), "19:30", "Nice", None, None, False)]
    assert [r.note for r in got] == ["21:00–01:30 · 10 euros / 8 euros · DJ Ana B", "20:00 · au chapeau", "19:30"]
    assert A.dance_table(raw(spark, "", "<p>x</p>"), AS_OF).count() == 0
