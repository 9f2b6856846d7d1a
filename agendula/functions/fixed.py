"""Word lists, lookup tables and patterns that results depend on. All matching is on folded text unless said otherwise."""

# --- categories, in the order of display
CATEGORIES = {
    "brocante": "Brocantes & vide-greniers", "danse": "Tango & dance", "concert": "Concerts", "expo": "Exhibitions",
    "scene": "Stage & theatre", "visite": "Guided visits", "atelier": "Workshops", "business": "Business, tech & AI",
    "social": "Social & expat", "sport": "Sport", "marche": "Markets & fêtes", "autre": "Clubs & other",
}

# --- category patterns; the first that matches decides
CATEGORY_PATTERNS = [
    (r"vide[- ]grenier|brocante|braderie|bourse|vide[- ]dressing|vide[- ]maison|chiner", "brocante"),
    (r"\bmilonga|\btango|practica|bal\b|guinguette|salsa|bachata|kizomba|zouk|swing|lindy|charleston|balboa|danse|dance|soirees? latin|latino|latina", "danse"),
    (r"exposition|\bexpo\b|vernissage|exhibition|galerie|retrospective|collection permanente", "expo"),
    (r"\bdj\b|dj set|clubbing|night ?club|boite de nuit|techno|\bhouse\b|\belectro\b|\brave\b|after[\s-]?party|club night|soiree club|apero club|warehouse", "autre"),
    (r"concert|jazz|live music|musique live|orchestre|philharmoni|chorale|recital|fanfare|blues|reggae|lyrique|art lyrique|chant lyrique|festival de musique", "concert"),
    (r"theatre|spectacle|opera|ballet|one man show|humour|cirque|danse contemporaine", "scene"),
    (r"visite guidee|visite|guided (tour|visit)|parcours patrimoine|balade", "visite"),
    (r"atelier|workshop|stage de|masterclass|initiation|cours\b", "atelier"),
    (r"conference|networking|afterwork|startup|\bai\b|\bia\b|intelligence artificielle|tech\b|pitch|hackathon|business|entrepreneur|coworking|summit|forum|salon professionnel|webinar", "business"),
    (r"expat|language exchange|echange linguistique|apero|picnic|pique-nique|rencontre|social|hangout|jeux de societe|board game|quiz|blind test", "social"),
    (r"marche|market|fete|festa|foire|festin|procession|feu d'artifice|carnaval|transhumance", "marche"),
    (r"course|trail|randonnee|match|tournoi|competition|marathon|regate|petanque|yoga|running|self.?defense|autodefense|arts martiaux|krav maga|boxe|fitness|pilates", "sport"),
]
DEFAULT_CATEGORY = "autre"

# --- words of sources' own type labels; the first contained decides
TYPE_WORDS = [
    ("exposition", "expo"), ("vernissage", "expo"), ("concert", "concert"), ("musique", "concert"), ("recital", "concert"),
    ("opera", "scene"), ("theatre", "scene"), ("spectacle", "scene"), ("cirque", "scene"), ("humour", "scene"), ("danse", "danse"),
    ("atelier", "atelier"), ("stage", "atelier"), ("masterclass", "atelier"), ("visite", "visite"), ("balade", "visite"), ("patrimoine", "visite"),
    ("conference", "business"), ("rencontre", "social"), ("lecture", "social"), ("brocante", "brocante"), ("vide-grenier", "brocante"), ("vide grenier", "brocante"),
    ("marche", "marche"), ("fete", "marche"), ("festin", "marche"), ("sport", "sport"), ("randonnee", "sport"), ("projection", "autre"), ("cinema", "autre"), ("film", "autre"),
]

# --- titles that are administration, not events
NON_EVENT_PATTERNS = [
    r"ouverture des inscriptions", r"\b(re)?inscriptions?\b", r"\badhesions?\b", r"\bcotisations?\b", r"renouvellement d.?adhesion",
    r"\babonnement", r"\bpermanences?\b", r"assemblee generale", r"\bconseil d.?administration\b", r"\breunion\b", r"appel a benevoles?", r"\bbenevolat\b",
    r"reprise des (cours|activites)", r"fin d.?annee.*(ecole|eleves|danse\b)", r"(gala|spectacle|representation).*(de l.?ecole|des eleves)", r"\bkermesse\b", r"\bloto associatif\b",
]

# --- towns by slug, and by postcode
TOWNS = {
    "nice": "Nice", "beaulieu-sur-mer": "Beaulieu-sur-Mer", "beaulieu": "Beaulieu-sur-Mer", "villefranche-sur-mer": "Villefranche-sur-Mer", "villefranche": "Villefranche-sur-Mer",
    "eze": "Èze", "eze-village": "Èze", "eze-sur-mer": "Èze", "cap-d-ail": "Cap-d'Ail", "cap-dail": "Cap-d'Ail",
    "saint-jean-cap-ferrat": "Saint-Jean-Cap-Ferrat", "st-jean-cap-ferrat": "Saint-Jean-Cap-Ferrat", "cagnes-sur-mer": "Cagnes-sur-Mer", "saint-laurent-du-var": "Saint-Laurent-du-Var",
    "st-laurent-du-var": "Saint-Laurent-du-Var", "vence": "Vence", "saint-paul-de-vence": "Saint-Paul-de-Vence", "st-paul-de-vence": "Saint-Paul-de-Vence",
    "antibes": "Antibes", "juan-les-pins": "Antibes", "cannes": "Cannes", "menton": "Menton", "grasse": "Grasse", "monaco": "Monaco", "beausoleil": "Beausoleil",
    "roquebrune-cap-martin": "Roquebrune-Cap-Martin", "la-turbie": "La Turbie", "tourrette-levens": "Tourrette-Levens", "luceram": "Lucéram", "sospel": "Sospel",
    "saint-martin-vesubie": "Saint-Martin-Vésubie", "levens": "Levens", "valdeblore": "Valdeblore", "la-gaude": "La Gaude", "castagniers": "Castagniers", "gourdon": "Gourdon",
    "roubion": "Roubion", "consegudes": "Conségudes", "cabris": "Cabris", "auribeau-sur-siagne": "Auribeau-sur-Siagne", "saint-vallier-de-thiey": "Saint-Vallier-de-Thiey",
    "la-trinite": "La Trinité", "drap": "Drap", "carros": "Carros", "colomars": "Colomars", "falicon": "Falicon", "aspremont": "Aspremont", "isola": "Isola", "isola-2000": "Isola 2000",
    "auron": "Auron", "la-colmiane": "La Colmiane", "roquebilliere": "Roquebillière", "saint-jeannet": "Saint-Jeannet", "le-broc": "Le Broc", "belvedere": "Belvédère",
    "tende": "Tende", "saint-dalmas-de-tende": "Tende",
}
POSTCODES = {
    "06000": "Nice", "06100": "Nice", "06200": "Nice", "06300": "Nice", "06310": "Beaulieu-sur-Mer", "06230": "Villefranche-sur-Mer", "06360": "Èze",
    "06320": "Cap-d'Ail", "06800": "Cagnes-sur-Mer", "06700": "Saint-Laurent-du-Var", "06140": "Vence", "06600": "Antibes", "06400": "Cannes", "06500": "Menton",
    "06130": "Grasse", "06690": "Tourrette-Levens", "06440": "Lucéram", "06380": "Sospel", "06450": "Saint-Martin-Vésubie", "06670": "Castagniers", "06620": "Gourdon",
    "06420": "Roubion", "06510": "Conségudes", "06530": "Cabris", "06810": "Auribeau-sur-Siagne", "06460": "Saint-Vallier-de-Thiey", "06610": "La Gaude", "06570": "Saint-Paul-de-Vence",
}
VENUE_WORDS = "espace salle theatre centre center parc musee chateau palais stade mediatheque bibliotheque complexe halle gymnase chapelle eglise ecole villa domaine hotel cinema galerie conservatoire auditorium forum stand".split()

# --- months
MONTHS = {
    "janvier": 1, "fevrier": 2, "février": 2, "mars": 3, "avril": 4, "mai": 5, "juin": 6, "juillet": 7, "aout": 8, "août": 8, "septembre": 9, "octobre": 10, "novembre": 11, "decembre": 12, "décembre": 12,
    "january": 1, "february": 2, "march": 3, "april": 4, "may": 5, "june": 6, "july": 7, "august": 8, "september": 9, "october": 10, "november": 11, "december": 12,
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "sept": 9, "oct": 10, "nov": 11, "dec": 12,
}

# --- title keys and markers
BADGES = r"\b(gratuit|free|nouveau|new|complet|sold ?out|annul\w*|cancell?ed)\b"
ARTICLES = r"\b(le|la|les|l|du|de|des|un|une|the|a|of|at|au|aux)\b"
SAYS_CANCELLED = r"\bannul\w*|\bcancell?ed\b"
CANCEL_MARKER = r"(?i)^\W*(?:annul\w*|cancell?ed)\W*"
TITLE_BADGE = r"(?i)\((gratuit|free|new|nouveau)\)"

# --- case of titles
KEEP_CAPS = (
    "DJ MC VIP AI IA EDM NFT XXL B2B VO VF MAMAC TNN OGC FC PACA MJC CCAS SNCF CNRS UNESCO LGBT LGBTQ UK USA CD DVD EP BD "
    "SOS JEP UTMB AMSL CIAP ESF AMA TAAC DAEU PAI UNAFAM CRESP EAC SCO EYM OVN REF LEC UVIA UMA"
).split()
ROMAN = "^[IVXLCDM]+$"
VOWEL = "(?iu)[AEIOUYÀÂÄÉÈÊËÎÏÔÖÙÛÜ]"
JOINERS = "a à au aux d de des du l la le les et en un une sur sous pour avec dans par the of at in on and with for to from".split()
EMOJI = r"[\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}\x{2B00}-\x{2BFF}\x{2190}-\x{21FF}\x{2300}-\x{23FF}\x{FE0F}\x{200D}\x{20E3}]"

# --- notes
NOTE_LABELS = (
    "concert atelier theatre spectacle projection brocante ballet vide-grenier rencontre exposition opera lecture animation danse humour conference visite "
    "festival stage cirque comedie recital expo scene marche sport social business one-man-show cabaret jazz cine cinema film"
).split()
SAYS_FREE = r"(?iu)(gratuit\w*|entr[ée]es?\s+libres?|acc[eè]s\s+libres?|free\s+entry)"
SAYS_PRICE = r"(?iu)(\d+[\.,]?\d*\s*(€|euros?)|\btarif|\bpayant|prix\s*:\s*\d)"

# --- slugs of cards and pages
CARD_STOP = (
    "vernissage exposition expo concert soiree spectacle atelier festival brocante marche visite balade projection l la le les de des du au aux un une et the a of "
    "at in on and with avec artiste artist en fete"
).split()
CATEGORY_SLUGS = {
    "marche": "brocantes-and-fetes", "danse": "tango-and-dance", "concert": "concerts", "expo": "exhibitions", "scene": "stage-and-theatre", "visite": "guided-visits",
    "atelier": "workshops", "business": "business-tech-and-ai", "social": "social-and-expat", "sport": "sport", "autre": "clubs-and-other",
}
RESERVED_SLUGS = [*CATEGORY_SLUGS.values(), "in", "privacy", "sitemap", "robots"]

# --- limits and horizons (days, rows, characters)
NEAR_DAYS, LD_DAYS, LD_ROWS = 42, 60, 150
PAGE_DAYS, PAGE_MIN, PAGE_ROWS, PAGE_LD_ROWS, NAV_TOWNS = 90, 5, 250, 100, 12
DIGEST_DAYS, DIGEST_ROWS, DIGEST_LIMIT = 60, 24, 200
RRULE_DAYS, NOTE_CHARS, TIME_ZONE = 120, 150, "Europe/Paris"

# --- lines of listing cards
SALE_KINDS = {
    "brocante": "Brocante", "vide-grenier": "Vide-grenier", "vide-greniers": "Vide-grenier", "braderie": "Braderie", "bourse de collection": "Bourse de collection",
    "vide-dressing": "Vide-dressing", "vide-maison": "Vide-maison", "marche de noel": "Marché de Noël",
}
SALE_SIZES = ["small", "medium-sized", "large", "very large"]
VENUE_COMMUNES = {"maison departementale de l'environnement": "Nice", "dome": "Nice", "espace laure ecard": "Nice"}

# --- flyers: categories by pattern, the first that matches; month abbreviations beyond those above
FLYER_PATTERNS = [
    (r"concert|dj\b|jazz|live|techno|house|electro|rock|rap|hip.?hop|club\b|soiree|apero.?club", "concert"), (r"expo|exposition|vernissage|galerie", "expo"), (r"theatre|spectacle|opera|ballet|humour|one.?man|cirque|impro", "scene"),
    (r"tango|milonga|salsa|bachata|kizomba|danse|dance|\bbal\b|swing|lindy", "danse"), (r"brocante|vide.?grenier|braderie|bourse", "brocante"), (r"atelier|workshop|\bstage\b|masterclass|initiation", "atelier"),
    (r"conference|meetup|networking|startup|business|pitch|forum", "business"), (r"marche\b|\bfete\b|foire|festin|carnaval|kermesse", "marche"), (r"visite|balade|parcours|patrimoine", "visite"),
    (r"yoga|course|trail|rando|match|tournoi|petanque|marathon", "sport"), (r"apero|rencontre|expat|quiz|jeux|blind.?test", "social"),
]
FLYER_MONTHS = {"janv": 1, "fev": 2, "fevr": 2, "avr": 4, "jui": 6, "juil": 7, "aou": 8, "sept": 9}

#: A venue and a title that say that an event is online.
ONLINE_VENUE = r"(?i)^\s*online\b|online\s+event"
ONLINE_TITLE = r"(?i)[\[(]\s*(?:online|en\s+ligne|virtual|virtuel|zoom|webinar)\s*[\])]|^\s*online\s*!+"

#: Classes of the parts of cards, by kind of page, and labels that say nothing about an event.
PLACE_CARD = {"block": "event-item__wrap", "title": "event-item__title-link", "place": "is-place", "chip": "event-item__category"}
GENRE_CARD = {"info": "info-container", "date": "date", "venue": "lieu", "genre": "genre"}
SEASON_CARD = {"year": "enveloppe__number", "block": "card", "title": "card__spectacle_title", "dates": "card__dates", "note": "card__description", "link": "card__link"}
EMPTY_CHIPS = ["accessible pmr", "gratuit"]

#: Patterns of titles, notes and texts.
TITLE_DEBRIS = r"\s{2,}|\|\s*$|^\s*-"
CLOCK_IN_TITLE = r"(?U)(?<![\w:.])(?:à\s+|at\s+|@\s*)?(?:(\d{1,2})\s*[hH]\s*(\d{2})?|(\d{1,2})\s*:\s*(\d{2}))(?![\d\w])"
BARE_CLOCK = r"(?i)^\d{1,2}\s*[h:]\s*\d{0,2}\s*$"
NOTE_LEAD = r"^\s*([^\s·][^·]{0,24}?)\s*·\s*"
NOTE_TIMES = r"^\s*\d{1,2}[:h]\d{2}(?:\s*[–-]\s*\d{1,2}[:h]\d{2})?\s*·\s*"
SEGMENT_ENDS = r"\s{2,}|[>•·]"
FROM_TO_HOURS = r"(?iu)\bde\s*(\d{1,2})\s*h\s*(\d{2})?\s*(?:à|a|au|jusqu|[-–])"
FROM_HOUR = r"(?iu)(?:à partir de|a partir de|d[èe]s|d[ée]but(?:e)?\s*(?:à|a)?)\s*(\d{1,2})\s*h\s*(\d{2})?"
CLASS_BEFORE = "(?iu)cours|pr[ée]c[ée]d|stage|initiation|atelier|d[ée]butant|workshop"
PRICE_LINE = r"(?iu)\b(?:tarifs?|prix|entr[ée]e)\s*:\s*(.{1,60}?)\s*$"
PRICE_WORDS = r"(?i)\d|gratuit|libre"
TO_POSTCODE = r"(?s)^(.*\b\d{5})\b"

#: Patterns of dates and times.
ISO_DATE = r"(?<!\d)(\d{4})-(\d{2})-(\d{2})(?!\d)"
COMPACT_DATE = r"^(\d{4})(\d{2})(\d{2})$"
SLASH_DATE = r"\b(\d{1,2})[/.](\d{1,2})[/.](\d{4})\b"
DAY_FIRST = r"(?U)\b(\d{1,2})(?:er)?\s+([A-Za-zÀ-ÿ]+)\.?(?:\s+(\d{4}))?"
MONTH_FIRST = r"(?U)\b([A-Za-zÀ-ÿ]+)\.?\s+(\d{1,2})(?:,)?(?:\s+(\d{4}))?"
HALF_DAY_CLOCK = r"\b(\d{1,2})\s*[:.]?\s*(\d{2})?\s*(am|pm)\b"
DAY_CLOCK = r"\b(\d{1,2})\s*[h:]\s*(\d{2})?"
CALENDAR_DAY, CALENDAR_CLOCK, CALENDAR_UTC = r"^\d{8}", r"^\d{8}T\d{4}", r"^\d{8}T\d{4}(?:\d{2})?Z"

#: Patterns of cards, flyers and addresses.
ABROAD = r"(?iu)\b(italie|italia|italy|espagne|spain|allemagne|germany|suisse|switzerland|belgique|belgium|portugal|united kingdom|england|usa)\b"
NO_VENUE = r'[{}\[\]"\\]|https?:|@type|startDate|schema\.org'
SALE_LINE = r"(\d{5})\s+-\s+([^\n]+?)(?:\s+-\s+(.+))?$"
SALE_COUNT = r"(?<![\d/])(\d{2,3})(?!\d)"
FLYER_DAY_NAMED = r"\b(\d{1,2})\s+([a-z]{3,9})\.?(?:\s+(\d{4}))?"
FLYER_DAY_SLASHED = r"\b(\d{1,2})/(\d{1,2})(?:/(\d{2,4}))?"
FLYER_NO_TITLE = r"(?i)^\d|https?:|www\.|\d\s*€|gratuit|entree|\bh\d|^\W+$"
EMAIL = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
