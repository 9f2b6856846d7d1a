"""Scalar expectations for text and date expressions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from agendula.functions import dates as D
from agendula.functions import text as T

AS_OF = dt.date(2026, 7, 15)


def ask(spark, function, values, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.o for r in rows.select("i", function(F.col("v")).alias("o")).orderBy("i").collect()]


def test_parse_date(spark):
    cases = {
        "1er septembre 2026": dt.date(2026, 9, 1), "20260718": dt.date(2026, 7, 18), "Sat, 11 Jul 2026": dt.date(2026, 7, 11), "32 Juillet 2026": None, "2026-07-18T10:00": dt.date(2026, 7, 18),
        "18/07/2026": dt.date(2026, 7, 18), "18.07.2026": dt.date(2026, 7, 18), "July 11, 2026": dt.date(2026, 7, 11), "11 août": dt.date(2026, 8, 11), "3 mars": dt.date(2027, 3, 3), "2026-02-30": None, "": None, "hello": None,
    }
    assert dict(zip(cases, ask(spark, lambda c: D.parse_date(c, F.lit(AS_OF)), list(cases)), strict=True)) == cases


def test_parse_time(spark):
    cases = {"19h": "19:00", "8:30pm": "20:30", "12:00am": "00:00", "19h30": "19:30", "19:30": "19:30", "7:00pm": "19:00", "25h": None, "no": None}
    assert dict(zip(cases, ask(spark, D.parse_time, list(cases)), strict=True)) == cases


def test_towns(spark):
    assert ask(spark, T.canon_town, ["st-jean-cap-ferrat", "06450", " Elsewhere ", "", None, "EZE"]) == ["Saint-Jean-Cap-Ferrat", "Saint-Martin-Vésubie", "Elsewhere", "Unknown", "Unknown", "Èze"]
    assert ask(spark, lambda c: T.canon_town(F.lit(None).cast("string"), c), ["06310"]) == ["Beaulieu-sur-Mer"]


def test_keys(spark):
    a, b, c, d = ask(spark, T.title_key, ["Brocante du Cours Saleya (Gratuit)", "BROCANTE COURS SALEYA", "(ANNULÉE) Milonga de la Casita", "Milonga Casita"])
    assert a == b == "brocante-cours-saleya" and c == d == "milonga-casita"
    assert ask(spark, T.slugify, ["Beaulieu-sur-Mer", "œuvre  _x", "ﬁn Été!"]) == ["beaulieu-sur-mer", "œuvre-x", "fin-ete"]


@pytest.mark.parametrize(("title", "category"), [("Vide-grenier du port", "brocante"), ("Milonga du jeudi", "danse"), ("Exposition Lévitation music", "expo"), ("DJ set sur la plage", "autre"), ("Jazz au jardin", "concert"), ("Théâtre: Molière", "scene"), ("Visite guidée", "visite"), ("Atelier poterie", "atelier"), ("Conférence IA", "business"), ("Language Exchange", "social"), ("Fête du village", "marche"), ("Yoga", "sport"), ("Mystère", "autre")])
def test_classify(spark, title, category):
    assert ask(spark, T.classify, [title]) == [category]


def test_types_and_nonevents(spark):
    assert ask(spark, T.category_from_type, ["Exposition", "Récital", "x", None]) == ["expo", "concert", None, None]
    drop = ["Inscriptions 2026", "Réinscription", "Assemblée générale", "Adhésion au club", "Gala de l'école", "Kermesse"]
    keep = ["Concert de fin d'année du Conservatoire", "Gala de danse argentine", "Visite libre"]
    assert ask(spark, T.is_nonevent, drop + keep) == [True] * len(drop) + [False] * len(keep)


def test_titles(spark):
    cases = {
        "LA NUIT DES MUSÉES": "La Nuit des Musées", "SOIRÉE DJ AU MAMAC AVEC VIP": "Soirée DJ au MAMAC avec VIP", 'MILONGA "LA NUEVA"': 'Milonga "La Nueva"', "Language Exchange ROOF TOP": "Language Exchange Roof Top",
        "OGC NICE / PSG": "OGC Nice / PSG", "Yoga (at Espace Rancher!": "Yoga (at Espace Rancher)", "Talk (": "Talk", "Fête 🎉 -": "Fête", "A — B": "A - B", "**Bold** &quot;x&quot;": 'Bold "x"', "MILONGA de la Liberté": "Milonga de la Liberté", "Henri XIV": "Henri XIV",
    }
    assert dict(zip(cases, ask(spark, T.clean_title, list(cases)), strict=True)) == cases


def test_time_from_title(spark):
    rows = [("Yoga 12h30 (at X park)", None), ("Yoga à 19h", "00:00"), ("Walk & Talk 1 : suite", None), ("Yoga 12h30", "18:00"), ("19:00", None), ("Bal 20:00", "20:00")]
    got = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, s string")
    title, time = T.time_from_title(F.col("t"), F.col("s"))
    assert [tuple(r) for r in got.select("i", title.alias("a"), time.alias("b")).orderBy("i").select("a", "b").collect()] == [
        ("Yoga (at X park)", "12:30"), ("Yoga", "19:00"), ("Walk & Talk 1 : suite", None), ("Yoga 12h30", "18:00"), ("19:00", "19:00"), ("Bal", "20:00")]


def test_cancellation(spark):
    assert ask(spark, T.says_cancelled, ["(ANNULÉE) x", "Annulés", "cancelled", "Canceled", "annuaire"]) == [True, True, True, True, False]
    assert ask(spark, T.strip_marker, ["(ANNULEE) MILONGA de la Casita", "Annulé"]) == ["MILONGA de la Casita", "Annulé"]


def test_notes(spark):
    cases = {"19:00 · Concert · real description": "real description", "21h00": "", "Hello · 21h00 · world": "Hello · world", "plain": "plain", "Unknown · text": "Unknown · text"}
    assert dict(zip(cases, ask(spark, T.note_full, list(cases)), strict=True)) == cases
    long = "First sentence that is quite long and goes on past sixty characters surely. " + "word " * 40
    short = ask(spark, T.shorten, ["x" * 150, long, "word " * 60, "y" * 200])
    assert short == ["x" * 150, "First sentence that is quite long and goes on past sixty characters surely.", ("word " * 30).strip() + "…", "y" * 150 + "…"]


def test_small_functions(spark):
    assert ask(spark, T.card_slug, ["Vernissage de l'artiste Jasmine", "Le la", "Été à Nice 2026"]) == ["jasmine", "le-la", "ete-nice"]
    assert ask(spark, T.says_free, ["Entrée libre", "gratuit, tarif 5€", "12 €", "Visite gratuite"]) == [True, False, False, True]
    assert ask(spark, T.title_case, ["cap d'ail"]) == ["Cap D'Ail"]
    assert ask(spark, lambda c: T.title_similarity(c, F.lit("Milonga du jeudi soir")), ["milonga du jeudi", "milonga jeudi matin ici", ""]) == [1.0, pytest.approx(2 / 6), 0.0]
    assert ask(spark, T.time_from_text, ["cours de 18h45 à 19h30 > Milonga de 21h00 à 01h30", "à partir de 19h", "19h"]) == ["21:00", "19:00", None]
    assert ask(spark, T.price_from_text, ["x  TARIF : 12€", "TARIFS  : 6€ (adhérents) / 8€", "prix : demandez"]) == ["12€", "6€ (adhérents) / 8€", None]
    venue, city, code = T.split_location(F.col("v"))
    assert ask(spark, lambda c: F.struct(venue, city, code), ["Le WAG, 5 Rue Leonetti 06160 Juan-les-Pins", "Bar"]) == [("Le WAG, 5 Rue Leonetti", "Juan-les-Pins", "06160"), ("Bar", None, None)]


def test_calendar_times(spark):
    day, time = D.ics_datetime(F.col("v"))
    cases = {"20260718T190000Z": (dt.date(2026, 7, 18), "21:00"), "20260718T233000Z": (dt.date(2026, 7, 19), "01:30"), "20260718": (dt.date(2026, 7, 18), None), "20260718T000000": (dt.date(2026, 7, 18), None), "20261025T003000Z": (dt.date(2026, 10, 25), "02:30"), "20261332": (None, None)}
    assert [tuple(r) for r in ask(spark, lambda c: F.struct(day, time), list(cases))] == list(cases.values())
    pairs = [("20260718T210000", "20260719T010000", None), ("20260718", "20260720", dt.date(2026, 7, 19)), ("20260718", "20260719", None), ("20260718T100000", "20260719T180000", dt.date(2026, 7, 19))]
    rows = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(pairs)], "i int, a string, b string")
    assert [r.o for r in rows.select("i", D.ics_end(F.col("a"), F.col("b")).alias("o")).orderBy("i").collect()] == [x for *_, x in pairs]
    assert ask(spark, lambda c: D.paris_offset(c.cast("date")), ["2026-08-01", "2026-12-01"]) == ["+02:00", "+01:00"]
    assert ask(spark, lambda c: D.ld_datetime(c.cast("date"), F.lit("20:30")), ["2026-08-01"]) == ["2026-08-01T20:30:00+02:00"]
    sat = lambda c: D.weekend(c.cast("date"))[0]
    assert ask(spark, sat, ["2026-07-18", "2026-07-19", "2026-07-20"]) == [dt.date(2026, 7, 18), dt.date(2026, 7, 25), dt.date(2026, 7, 25)]
    assert ask(spark, lambda c: D.nth_weekday(c.cast("date"), "TH", -1), ["2026-07-01"]) == [dt.date(2026, 7, 30)]


def test_cards(spark):
    from agendula.functions import cards as C

    assert ask(spark, C.town_in_text, ["12ter Place Garibaldi 06 NICE", "st-jean-cap-ferrat plage, Nice", "Venice Beach", "", None]) == ["Nice", "Saint-Jean-Cap-Ferrat", None, None, None]
    assert ask(spark, lambda c: C.commune_of_place(c, "06"), ["Vence - Salle", "Le DOME, parc", "", "Gourdon"]) == ["Vence", "Nice", "06", "Gourdon"]
    assert ask(spark, C.genre_category, ["Concert pop", "Hip-hop", "Drame", None]) == ["concert", "danse", "scene", "scene"]
    card = C.sale_card(F.col("v"))
    assert ask(spark, lambda c: F.struct(*card.values()), ["Sale ~80 stands 06300 - Vide-greniers - Place X", "•• 06300 - Marché de Noël", '06300 - brocante - {"@type"}']) == [("06300", "Place X", "Vide-grenier · ~80 exhibitors"), ("06300", None, "Marché de Noël · medium-sized market"), ("06300", None, "Brocante")]
    assert ask(spark, lambda c: C.without_town(c, F.lit("Consegudes")), ["Conségudes - Brocante", "Brocante", "Conségudes"]) == ["Brocante", "Brocante", "Conségudes"]
    venue = lambda s, p, t: lambda c: C.venue_of_address(c, F.lit(s), F.lit(p), F.lit(t))
    assert ask(spark, venue("5 rue X", "06000", "Nice"), ["Le 109 5 rue X 06000 Nice", "5 rue X 06000 Nice"]) == ["Le 109", "5 rue X"]
    assert ask(spark, venue("", "", "Nice"), ["Plage Mar 15 Promenade Y 06000 Nice"]) == ["Plage Mar"]
    flyer = "www.x.org\nGRAND BAL TANGO\nsamedi 18 juillet a 20h30\nVence, gratuit"
    got = ask(spark, lambda c: C.flyer_fields(c, F.lit(AS_OF)), [flyer, "Jazz 3/2"])
    assert (got[0].title, got[0].date, got[0].time, got[0].town, got[0].category) == ("GRAND BAL TANGO", dt.date(2026, 7, 18), "20:30", "Vence", "danse") and (got[1].date, got[1].category) == (dt.date(2027, 2, 3), "concert")
    assert ask(spark, lambda c: C.first_present(F.lit(""), c), ["a", " ", None]) == ["a", None, None]
    assert ask(spark, lambda c: C.in_scope(c, F.lit(None).cast("string")), ["Milano, Italia", "room 3"]) == [False, True]
