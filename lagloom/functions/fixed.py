"""Results are only right with exactly these lists, names and patterns. They are data, in natural order."""

from __future__ import annotations

LAGS = [0, 7, 14, 30, 60, 90]
MIN_N = 150

TOPICS = {
    "oil": ["oil", "Brent", "crude", "energy"],
    "rate": ["interest rate", "central bank", "key rate", "CBR"],
    "ruble": ["ruble", "RUB", "Russian currency"],
    "sanctions": ["sanction", "embargo", "Russia ban"],
    "inflation": ["inflation", "CPI", "consumer price"],
    "banking": ["banking", "bank sector", "financial sector"],
    "gold": ["gold", "precious metal"],
}

CURRENCIES = {
    "Армянский драм": "AMD",
    "Белорусский рубль": "BYN",
    "Вона Республики Корея": "KRW",
    "Гонконгский доллар": "HKD",
    "Дирхам ОАЭ": "AED",
    "Доллар США": "USD",
    "Евро": "EUR",
    "Индийская рупия": "INR",
    "Казахстанский тенге": "KZT",
    "Канадский доллар": "CAD",
    "Китайский юань": "CNY",
    "Киргизский сом": "KGS",
    "Швейцарский франк": "CHF",
    "Японская иена": "JPY",
    "Фунт стерлингов": "GBP",
    "Таджикский сомони": "TJS",
    "Туркменский манат": "TMT",
    "Узбекский сум": "UZS",
    "Южноафриканский рэнд": "ZAR",
}

INSTRUMENT_FILES = {
    "Прошлые данные - USD_RUB.csv": "USD_RUB",
    "Прошлые данные - EUR_RUB.csv": "EUR_RUB",
    "Прошлые данные - US 500 Cash.csv": "SP500",
    "Прошлые данные - Фьючерс на золото.csv": "GOLD",
    "Прошлые данные - Фьючерс на нефть Brent.csv": "BRENT",
    "Прошлые данные - Фьючерс на индекс USD.csv": "DXY",
    "Прошлые данные - MSCI World.csv": "MSCI_WORLD",
    "Прошлые данные - Dow Jones South Africa.csv": "DJ_SOUTH_AFRICA",
    "Прошлые данные - FTSE China 50 Price Return Local.csv": "FTSE_CHINA_50",
    "Прошлые данные - MSCI India Net USD.csv": "MSCI_INDIA",
    "История котировок фьючерса Китай H-Shares.csv": "CHINA_H_SHARES",
    "Прошлые данные - TR_CC CRB Aluminum.csv": "ALUMINUM",
    "Прошлые данные - Фьючерс на серебро.csv": "SILVER",
}

#: Stem in a hypothesis -> search terms in the news.
STEMS = {
    "ставк": ["interest rate", "key rate"],
    "цб": ["central bank", "CBR"],
    "нефть": ["oil", "crude"],
    "нефт": ["oil", "Brent"],
    "газ": ["natural gas", "Gazprom"],
    "рубл": ["ruble", "RUB"],
    "санкц": ["sanctions", "Russia"],
    "банк": ["bank", "banking"],
    "финанс": ["financial", "finance"],
    "акци": ["stock", "equity"],
    "инфляц": ["inflation", "CPI"],
    "экспорт": ["export", "commodity"],
    "зарплат": ["wages", "salary"],
    "золото": ["gold", "precious metals"],
    "золот": ["gold", "metals"],
    "недвижим": ["real estate", "housing"],
    "ипотек": ["mortgage", "housing loan"],
    "moexfn": ["financial sector", "banking sector"],
    "moexog": ["oil gas", "energy sector"],
    "imoex": ["Moscow Exchange", "Russian stock"],
    "sp500": ["S&P 500", "US market"],
    "brent": ["Brent", "crude oil"],
    "usd": ["dollar", "USD"],
    "корреляц": ["correlation", "market"],
    "сектор": ["sector", "industry"],
    "индекс": ["index", "benchmark"],
    "волатильн": ["volatility", "market risk"],
    "режим": ["regime", "policy"],
    "дивиденд": ["dividend", "yield"],
}
FALLBACK_TERMS = ["Russia", "financial market", "economy"]

#: Error class -> substrings of its messages; the first class that matches counts.
ERROR_CLASSES = {
    "window_in_where": ["WHERE clause cannot contain window functions"],
    "lag_scalar": ["Scalar Function with name lag", "Scalar Function with name lead"],
    "schema_column": ["Referenced column", "not found in FROM clause", "Column with name"],
    "type_arithmetic": ["No function matches the given name and argument types"],
    "type_cast": ["Conversion Error", "Could not convert", "Cannot cast"],
    "catalog": ["Catalog Error"],
    "binder": ["Binder Error"],
    "syntax": ["Parser Error", "syntax error"],
    "corr_null": [],
}

FOREIGN_INSTRUMENTS = ["ftse_china_50", "dxy", "msci_india", "msci_world", "dj_south_africa", "china_h_shares", "silver", "sp500", "aluminum"]
CONTEXT_COLUMNS = ["imoex_close", "usd_rub", "eur_rub", "brent_usd", "gold_usd", "key_rate_pct"]
TAUTOLOGY_PAIRS = [("eur_rub", "usd_rub")]
INACTIVE_REGIME = [r"key_rate_pct\s*<\s*1[0-9]", r"rate_pct\s*<\s*1[0-9]", r"[\"']low_rate[\"']", r"usd_rub\s*<\s*7\d"]
ACTIVE_REGIME = [
    r"key_rate_pct\s*[>≥]\s*(19|20|21)",
    r"key_rate_pct\s*>=\s*(19|20|21)",
    r"[\"']high_rate[\"']",
    r"usd_rub\s*[>≥]\s*(80|85|90)",
    r"usd_rub\s*>=\s*(80|85|90)",
]
STRUCTURAL = [r"\bsilver\b.*\brugold\b", r"\brugold\b.*\bsilver\b"]
MIN_R, STRUCTURAL_DELTA, CONVERGENCE_MIN, RERUN_MIN_SCORE = 0.30, 0.08, 3, 65
CURRENT_REGIME = {"key_rate_pct": 21.0, "usd_rub": 85.0}

CHUNK_CHARS, CHUNK_STEP, CHUNK_MIN = 900, 700, 50
PRICE_IN, PRICE_OUT = 0.014, 0.028
