"""Fixed values.

Units of each currency per one US dollar, and pay plausibility bounds.

These strings decide results, so they are stated exactly and in matching order.
"""

PER_USD = {
    "USD": 1.0,
    "EUR": 0.92,
    "GBP": 0.79,
    "CAD": 1.37,
    "AUD": 1.52,
    "CHF": 0.88,
    "SGD": 1.34,
    "INR": 84.0,
    "JPY": 150.0,
    "CNY": 7.2,
    "MXN": 18.0,
    "BRL": 5.4,
    "ZAR": 18.5,
    "SEK": 10.6,
    "NOK": 10.8,
    "DKK": 6.9,
    "PLN": 3.9,
    "CZK": 23.0,
    "HUF": 360.0,
    "RON": 4.6,
    "TRY": 34.0,
    "ILS": 3.7,
    "AED": 3.67,
    "SAR": 3.75,
    "NZD": 1.64,
    "HKD": 7.8,
    "KRW": 1350.0,
    "TWD": 32.0,
    "THB": 35.0,
    "PHP": 57.0,
    "IDR": 15800.0,
    "VND": 25000.0,
    "MYR": 4.4,
    "COP": 4000.0,
    "CLP": 950.0,
    "ARS": 1000.0,
    "PKR": 278.0,
    "BDT": 120.0,
    "LKR": 300.0,
    "EGP": 49.0,
    "NGN": 1600.0,
    "KES": 129.0,
    "UAH": 41.0,
    "RUB": 92.0,
}

MIN_ANNUAL_USD = 15000.0
MAX_ANNUAL_USD = 2000000.0
HOURS_PER_YEAR = 2080
