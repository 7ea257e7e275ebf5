"""Multilingual word lists that drive name-based recognition.

Order matters: the first word contained in a column name decides.
"""

# Words in the names of prices (English, Italian, French, Spanish, German, Portuguese).
PRICE = [
    "price", "unit_price", "list_price", "sale_price", "selling_price", "cost", "amount", "value", "rate", "fee",
    "fare", "charge", "revenue", "sales", "gross", "net", "total", "subtotal", "tariff", "billing", "invoice",
    "prezzo", "costo", "importo", "valore", "ricavo", "vendita", "fattura", "tariffa", "quota", "prix", "montant",
    "valeur", "cout", "coût", "tarif", "recette", "chiffre", "precio", "costo", "importe", "valor", "venta",
    "tarifa", "ingreso", "cobro", "preis", "kosten", "betrag", "wert", "einnahme", "preco", "preço", "custo",
    "valor", "receita",
]

# Words in the names of quantities.
QUANTITY = [
    "qty", "quantity", "count", "num", "number", "amount", "stock", "units", "volume", "total", "sum", "n_",
    "pieces", "items", "orders", "sold", "quantita", "quantità", "qta", "numero", "pezzi", "scorte", "unita",
    "unità", "totale", "quantite", "quantité", "nombre", "unites", "unités", "stock", "pieces", "cantidad", "numero",
    "unidades", "piezas", "existencias", "menge", "anzahl", "einheiten", "bestand", "quantidade", "numero",
    "unidades", "pecas",
]

# Words in the names of identifiers, and the affixes that count more.
ID = [
    "_id", "id_", "_key", "key_", "_code", "code_", "_cod", "cod_", "_num", "num_", "id", "identifier", "uuid",
    "guid", "sku", "barcode", "reference", "ref", "serial", "token", "codice", "identificativo", "matricola",
    "progressivo", "identifiant", "code", "référence", "numero", "identificador", "codigo", "referencia", "kennung",
    "nummer", "schlüssel",
]
ID_AFFIXES = [
    "id", "id_", "key", "key_", "code", "code_", "cod", "cod_",
]

# Words in the names of dates, and the separators seen in date strings.
DATE = [
    "date", "time", "timestamp", "datetime", "created", "updated", "modified", "deleted", "day", "month", "year",
    "week", "hour", "start", "end", "begin", "expiry", "expiration", "due", "deadline", "birth", "dob", "shipped",
    "delivered", "ordered", "closed", "data", "ora", "giorno", "mese", "anno", "settimana", "creato", "aggiornato",
    "inizio", "fine", "scadenza", "nascita", "date", "heure", "jour", "mois", "annee", "année", "debut", "fin",
    "echeance", "naissance", "fecha", "hora", "dia", "mes", "ano", "año", "inicio", "fin", "vencimiento",
    "nacimiento", "datum", "zeit", "tag", "monat", "jahr", "beginn", "ende",
]

# Words in the names of percentages.
PERCENTAGE = [
    "pct", "percent", "percentage", "rate", "ratio", "share", "prob", "probability", "proportion", "fraction",
    "perc", "utilization", "utilisation", "coverage", "fill", "growth", "change", "delta", "variance", "margin",
    "percentuale", "tasso", "quota", "proporzione", "probabilità", "probabilita", "variazione", "crescita",
    "pourcentage", "taux", "part", "proportion", "croissance", "porcentaje", "tasa", "proporcion", "probabilidad",
    "crecimiento", "prozent", "anteil", "rate", "wahrscheinlichkeit",
]

# Words in the names of categories.
CATEGORICAL = [
    "status", "state", "type", "category", "cat", "class", "group", "role", "gender", "brand", "country", "region",
    "segment", "tier", "level", "channel", "source", "medium", "flag", "label", "tag", "mode", "kind", "stato",
    "tipo", "categoria", "classe", "gruppo", "ruolo", "genere", "marca", "paese", "regione", "segmento", "livello",
    "statut", "type", "catégorie", "classe", "groupe", "pays", "estado", "tipo", "categoria", "clase", "grupo",
    "pais", "status", "typ", "kategorie", "klasse", "gruppe", "land",
]

# Words in the names of free text.
TEXT = [
    "description", "text", "notes", "note", "comment", "comments", "message", "body", "content", "summary", "detail",
    "details", "address", "street", "remark", "remarks", "feedback", "narrative", "reason", "explanation", "info",
    "information", "bio", "biography", "abstract", "review", "descrizione", "testo", "nota", "commento", "messaggio",
    "contenuto", "sommario", "dettaglio", "indirizzo", "via", "motivo", "spiegazione", "informazione", "recensione",
    "description", "texte", "note", "commentaire", "message", "contenu", "adresse", "remarque", "explication",
    "avis", "descripcion", "texto", "nota", "comentario", "mensaje", "contenido", "direccion", "motivo",
    "explicacion", "resena", "beschreibung", "text", "notiz", "kommentar", "nachricht", "inhalt", "adresse",
    "bemerkung", "erklarung",
]

# Personal data by name, in order of precedence.
PII = {
    "email": "email", "mail": "email", "phone": "phone", "mobile": "phone", "tel": "phone",
    "name": "name", "nome": "name", "surname": "name", "cognome": "name",
    "address": "address", "indirizzo": "address", "street": "address",
    "iban": "financial", "card": "financial", "credit": "financial",
    "fiscal": "government_id", "tax": "government_id", "ssn": "government_id", "passport": "government_id",
    "dob": "birth_date", "birth": "birth_date",
}

# Personal data by content (whole trimmed value).
EMAIL_PATTERN = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
PHONE_PATTERN = r"^\+?[0-9][0-9\-\s]{7,}$"

# Protected attributes by name, in order of precedence.
PROTECTED = {
    "gender": "gender", "sex": "gender", "age": "age", "birth": "age",
    "country": "geography", "region": "geography", "city": "geography", "zip": "geography", "cap": "geography",
    "race": "sensitive", "ethnicity": "sensitive", "religion": "sensitive", "marital": "demographic",
    "disability": "sensitive", "nationality": "geography",
}

# Class labels read as the positive class.
POSITIVE_CLASS = [
    "1", "true", "yes", "y", "si", "positive", "fraud", "churn", "default", "active",
]

# Name hints of the derived-column rules.
UNIT_PRICE = [
    "unit", "single", "each", "per", "unitario", "unitaria", "list", "base", "standard", "regular",
]
TOTAL_PRICE = [
    "total", "totale", "sum", "gross", "net", "subtotal", "revenue", "ricavo", "amount", "importo",
]
SELLING = [
    "selling", "sale", "sell", "vendita", "list", "retail", "price", "prezzo", "prix", "precio",
]
COST = [
    "cost", "costo", "purchase", "acquisto", "buying", "wholesale", "ingrosso", "supplier", "fornitore",
]
DISCOUNT = [
    "discount", "sconto", "rebate", "remise", "descuento", "rabatt", "reduction", "promo",
]
RATIO_PAIRS = (
    ("sold venduto vendite sales".split(), "stock available disponibile inventory".split(), "sell_through_rate"),
    ("orders ordini".split(), "customers clienti users utenti".split(), "orders_per_customer"),
    ("returns resi refunds".split(), "sold venduto sales vendite".split(), "return_rate"),
    ("completed completati done".split(), "total totale all tutti".split(), "completion_rate"),
    ("active attivi".split(), "total totale".split(), "activation_rate"),
)

# Texts that stand for a missing value (after trim and lower case).
MASKED_MISSING = ("", "na", "n/a", "null", "none", "nan", "nd", "n.d.", "-", "--", "?")

# Texts read as boolean.
BOOLEAN = [
    "0", "1", "true", "false", "yes", "no", "si", "t", "f", "y", "n",
]
TRUE_WORDS = [
    "true", "1", "yes", "si", "t", "y",
]
FALSE_WORDS = [
    "false", "0", "no", "f", "n",
]

# Name patterns of the semantic typer.
ID_NAME = r"\b(id|key|uuid|guid|code|cod|codice|pk|fk|ref|hash)\b"
GEO_NAME = r"\b(lat|latitude|latitudine|lon|lng|longitude|longitudine)\b"

# Timestamps that name an event after the outcome.
POST_EVENT = [
    "updated", "closed", "resolved", "approved", "deleted",
]


def first_word_score(name: str, words, exact: float, partial: float) -> float:
    """Score of the first listed word that the lower-cased name contains."""
    name = name.lower()
    hit = next((w for w in words if w in name), None)
    return 0.0 if hit is None else (exact if hit == name else partial)
