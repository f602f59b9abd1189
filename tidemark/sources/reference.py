"""Reference data: exchange rates, aliases and risks, as small tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: US dollars for one unit of a currency: fixed values.
RATES: dict[str, float] = {
    "USD": 1.0, "EUR": 1.084, "GBP": 1.265, "CAD": 0.735, "AUD": 0.652, "JPY": 0.0064, "CHF": 1.118, "CNY": 0.138, "INR": 0.012, "BRL": 0.195,
    "MXN": 0.058, "SGD": 0.742, "HKD": 0.128, "KRW": 0.00073, "SEK": 0.092, "NOK": 0.093, "NZD": 0.605, "ZAR": 0.054, "AED": 0.272, "SAR": 0.2667,
}
#: Names of currencies: fixed values.
CURRENCY_ALIASES: dict[str, str] = {
    "dollar": "USD", "dollars": "USD", "usd": "USD", "us_dollar": "USD", "euro": "EUR", "euros": "EUR", "eur": "EUR", "pound": "GBP", "pounds": "GBP",
    "gbp": "GBP", "sterling": "GBP", "yen": "JPY", "jpy": "JPY", "cad": "CAD", "canadian_dollar": "CAD", "aud": "AUD", "australian_dollar": "AUD",
}
#: Names and three-letter codes of countries: fixed values.
COUNTRY_ALIASES: dict[str, str] = {
    "united states": "US", "united states of america": "US", "usa": "US", "us": "US", "u.s.": "US", "u.s.a.": "US", "united kingdom": "GB", "uk": "GB",
    "great britain": "GB", "england": "GB", "canada": "CA", "australia": "AU", "germany": "DE", "deutschland": "DE", "france": "FR", "japan": "JP",
    "china": "CN", "india": "IN", "brazil": "BR", "brasil": "BR", "mexico": "MX", "méxico": "MX", "russia": "RU", "nigeria": "NG", "south africa": "ZA",
    "singapore": "SG", "hong kong": "HK", "south korea": "KR", "korea": "KR", "new zealand": "NZ", "netherlands": "NL", "holland": "NL", "spain": "ES",
    "españa": "ES", "italy": "IT", "italia": "IT", "sweden": "SE", "norway": "NO", "switzerland": "CH", "ireland": "IE", "philippines": "PH",
    "indonesia": "ID", "vietnam": "VN", "ukraine": "UA", "poland": "PL", "turkey": "TR", "taiwan": "TW", "thailand": "TH", "argentina": "AR",
    "colombia": "CO", "chile": "CL", "peru": "PE", "egypt": "EG", "pakistan": "PK", "bangladesh": "BD", "iran": "IR", "north korea": "KP", "syria": "SY",
    "cuba": "CU", "sudan": "SD", "saudi arabia": "SA", "uae": "AE", "united arab emirates": "AE", "USA": "US", "GBR": "GB", "CAN": "CA", "AUS": "AU",
    "DEU": "DE", "FRA": "FR", "JPN": "JP", "CHN": "CN", "IND": "IN", "BRA": "BR", "MEX": "MX", "RUS": "RU", "NGA": "NG", "ZAF": "ZA", "SGP": "SG",
    "HKG": "HK", "KOR": "KR", "NZL": "NZ", "NLD": "NL", "ESP": "ES", "ITA": "IT", "SWE": "SE", "NOR": "NO", "CHE": "CH", "IRL": "IE", "PHL": "PH",
    "IDN": "ID", "VNM": "VN", "UKR": "UA", "POL": "PL", "TUR": "TR", "TWN": "TW", "THA": "TH", "ARG": "AR", "COL": "CO", "CHL": "CL", "PER": "PE",
    "EGY": "EG", "PAK": "PK", "BGD": "BD", "IRN": "IR", "PRK": "KP", "SYR": "SY", "CUB": "CU", "SDN": "SD", "SAU": "SA", "ARE": "AE",
}
#: Names of transaction types: fixed values.
TYPE_ALIASES: dict[str, str] = {
    "purchase": "purchase", "buy": "purchase", "sale": "purchase", "debit": "purchase", "pos": "purchase", "payment": "purchase",
    "withdrawal": "withdrawal", "withdraw": "withdrawal", "cash_out": "withdrawal", "atm_withdrawal": "withdrawal", "cashout": "withdrawal",
    "transfer": "transfer", "xfer": "transfer", "wire": "transfer", "wire_transfer": "transfer", "p2p": "transfer", "ach": "transfer",
    "send": "transfer", "refund": "refund", "return": "refund", "reversal": "refund", "chargeback": "refund", "credit": "refund", "cashback": "refund",
}
#: Names of channels: fixed values.
CHANNEL_ALIASES: dict[str, str] = {
    "online": "online", "web": "online", "ecommerce": "online", "e-commerce": "online", "internet": "online", "website": "online", "pos": "pos",
    "point_of_sale": "pos", "in_store": "pos", "instore": "pos", "in-store": "pos", "retail": "pos", "terminal": "pos", "chip": "pos", "swipe": "pos",
    "contactless": "pos", "tap": "pos", "atm": "atm", "cash_machine": "atm", "automated_teller": "atm", "mobile": "mobile", "app": "mobile",
    "mobile_app": "mobile", "phone": "mobile", "smartphone": "mobile", "in_app": "mobile", "in-app": "mobile",
}
#: Names of card types: fixed values.
CARD_ALIASES: dict[str, str] = {
    "credit": "credit", "credit_card": "credit", "cc": "credit", "visa": "credit", "mastercard": "credit", "amex": "credit", "debit": "debit",
    "debit_card": "debit", "dc": "debit", "check_card": "debit", "prepaid": "prepaid", "prepaid_card": "prepaid", "gift_card": "prepaid",
    "stored_value": "prepaid", "reloadable": "prepaid",
}
#: Merchant categories by code: fixed values.
MCC_NAMES: dict[str, str] = {
    "5411": "grocery_stores", "5422": "meat_markets", "5441": "candy_stores", "5451": "dairy_products", "5462": "bakeries", "5499": "misc_food_stores",
    "5200": "home_supply", "5211": "building_materials", "5251": "hardware_stores", "5261": "nurseries_garden", "5300": "wholesale_clubs",
    "5310": "discount_stores", "5311": "department_stores", "5331": "variety_stores", "5399": "misc_general_merchandise", "5611": "mens_clothing",
    "5621": "womens_clothing", "5631": "womens_accessories", "5641": "childrens_clothing", "5651": "family_clothing", "5661": "shoe_stores",
    "5699": "misc_apparel", "5722": "household_appliances", "5732": "electronics_stores", "5734": "computer_software", "5735": "record_shops",
    "5945": "hobby_toy_game", "5946": "camera_photo", "3000": "airlines", "3500": "car_rental", "4111": "local_transit", "4112": "railroads",
    "4121": "taxi_rideshare", "4131": "bus_lines", "4411": "cruise_lines", "4511": "airlines_carriers", "4722": "travel_agencies", "4784": "tolls",
    "4789": "transportation_services", "7011": "hotels_motels", "7012": "timeshares", "7032": "recreation_camps", "7033": "trailer_parks",
    "5812": "restaurants", "5813": "bars_nightclubs", "5814": "fast_food", "5511": "auto_dealers_new", "5521": "auto_dealers_used", "5531": "auto_parts",
    "5532": "auto_supply", "5533": "auto_parts_accessories", "5541": "gas_stations", "5542": "fuel_automated", "5571": "motorcycle_dealers",
    "7531": "auto_body_repair", "7534": "tire_retreading", "7535": "auto_paint", "7538": "auto_service_shops", "7542": "car_washes",
    "4814": "telecom_services", "4816": "computer_network", "4900": "utilities", "5943": "office_supplies", "5944": "jewelry_stores",
    "5947": "gift_novelty", "5948": "luggage_leather", "5949": "sewing_fabric", "5970": "art_dealers", "5971": "art_craft_supply", "5972": "stamp_coin",
    "5973": "religious_goods", "5912": "drug_stores", "5975": "hearing_aids", "5976": "orthopedic", "5977": "cosmetic_stores", "8011": "doctors",
    "8021": "dentists", "8031": "osteopaths", "8041": "chiropractors", "8042": "optometrists", "8043": "opticians", "8049": "podiatrists",
    "8050": "nursing_care", "8062": "hospitals", "8071": "medical_labs", "8099": "health_services", "6010": "financial_cash_disbursement",
    "6011": "atm_cash", "6012": "financial_services", "6051": "crypto_currency_exchange", "6211": "securities_brokers", "6300": "insurance",
    "6513": "real_estate", "7800": "government_lottery", "7801": "casino_internet_gambling", "7802": "horse_dog_racing", "7829": "motion_picture",
    "7832": "movie_theaters", "7841": "video_rental", "7911": "dance_studios", "7922": "theatrical_productions", "7929": "entertainment",
    "7932": "billiard_pool", "7933": "bowling", "7941": "sports_clubs", "7991": "tourist_attractions", "7992": "golf_courses",
    "7993": "video_game_arcades", "7994": "video_game_supply", "7995": "gambling_betting", "7996": "amusement_parks", "7997": "clubs_membership",
    "7998": "aquariums", "7999": "recreation_services", "8211": "schools", "8220": "colleges_universities", "8241": "correspondence_schools",
    "8244": "business_schools", "8249": "vocational_schools", "8299": "educational_services", "9211": "court_costs", "9222": "fines",
    "9311": "tax_payments", "9399": "government_services", "9402": "postal_services", "5815": "digital_goods_media", "5816": "digital_goods_games",
    "5817": "digital_goods_software", "5818": "digital_goods_marketplace", "5933": "pawn_shops", "5962": "direct_marketing_travel",
    "5966": "direct_marketing_outbound", "5967": "direct_marketing_inbound", "4829": "money_transfer",
}
#: Risk of countries that are listed: fixed values.
COUNTRY_RISK: dict[str, float] = {
    "KP": 1.0, "IR": 0.95, "MM": 0.9, "AF": 0.85, "SY": 0.85, "YE": 0.8, "SO": 0.8, "SD": 0.8, "LY": 0.75, "IQ": 0.75, "SS": 0.75, "VE": 0.7, "CU": 0.7,
    "NG": 0.65, "PK": 0.6, "RU": 0.65, "BY": 0.6, "UA": 0.5, "CM": 0.55, "GH": 0.55, "KE": 0.5, "PH": 0.5, "VN": 0.5, "CN": 0.4, "IN": 0.35, "BR": 0.4,
    "MX": 0.4, "CO": 0.4, "ZA": 0.35, "TR": 0.35, "ID": 0.3, "US": 0.1, "GB": 0.1, "CA": 0.1, "AU": 0.1, "DE": 0.1, "FR": 0.1, "JP": 0.1, "SG": 0.05,
    "CH": 0.1,
}
#: Risk of merchant categories by code, or by its first two digits and xx: fixed values.
MCC_RISK: dict[str, float] = {
    "7995": 0.9, "7994": 0.5, "7993": 0.3, "4829": 0.85, "6051": 0.85, "6012": 0.7, "6211": 0.7, "5967": 0.75, "7273": 0.8, "5966": 0.75, "4511": 0.5,
    "3000": 0.5, "7011": 0.4, "7512": 0.4, "5732": 0.55, "5944": 0.6, "5094": 0.65, "5815": 0.5, "5816": 0.55, "5818": 0.45, "5968": 0.5, "5541": 0.4,
    "5542": 0.45, "5812": 0.2, "5814": 0.15, "5811": 0.25, "5411": 0.1, "5422": 0.1, "4900": 0.05, "4814": 0.15, "8011": 0.05, "8021": 0.05,
    "8062": 0.05, "5912": 0.1, "8220": 0.05, "8211": 0.05, "9211": 0.05, "9222": 0.05, "9311": 0.05, "5311": 0.15, "5331": 0.15, "5651": 0.2,
    "59xx": 0.2, "58xx": 0.2, "80xx": 0.1, "74xx": 0.25,
}


def mapped(table: dict[str, object], key: Column) -> Column:
    """The entry of a small table for ``key``; null if there is none. The table is a literal map inside the plan."""
    literal = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.try_element_at(literal, key)


def as_frame(spark: SparkSession, table: dict[str, object], key: str = "key", value: str = "value") -> DataFrame:
    """A table's entries as rows, for joins."""
    kind = "double" if isinstance(next(iter(table.values())), float) else "string"
    return spark.createDataFrame(list(table.items()), f"{key} string, {value} {kind}")
