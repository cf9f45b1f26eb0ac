"""Reference data of the card domain."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Fixed values, which results depend on: cities (name, country, latitude, longitude, currency, weight).
CITIES = (
    ("New York", "US", 40.7128, -74.0060, "USD", 10.0),
    ("Los Angeles", "US", 34.0522, -118.2437, "USD", 8.0),
    ("Chicago", "US", 41.8781, -87.6298, "USD", 6.0),
    ("Houston", "US", 29.7604, -95.3698, "USD", 5.0),
    ("Dallas", "US", 32.7767, -96.7970, "USD", 4.0),
    ("San Francisco", "US", 37.7749, -122.4194, "USD", 4.0),
    ("Phoenix", "US", 33.4484, -112.0740, "USD", 3.0),
    ("Philadelphia", "US", 39.9526, -75.1652, "USD", 3.0),
    ("Seattle", "US", 47.6062, -122.3321, "USD", 3.0),
    ("Miami", "US", 25.7617, -80.1918, "USD", 3.0),
    ("Boston", "US", 42.3601, -71.0589, "USD", 3.0),
    ("Atlanta", "US", 33.7490, -84.3880, "USD", 3.0),
    ("Denver", "US", 39.7392, -104.9903, "USD", 2.0),
    ("Austin", "US", 30.2672, -97.7431, "USD", 2.0),
    ("Toronto", "CA", 43.6532, -79.3832, "CAD", 3.0),
    ("Vancouver", "CA", 49.2827, -123.1207, "CAD", 2.0),
    ("Mexico City", "MX", 19.4326, -99.1332, "MXN", 2.0),
    ("Sao Paulo", "BR", -23.5505, -46.6333, "BRL", 2.0),
    ("London", "GB", 51.5074, -0.1278, "GBP", 4.0),
    ("Paris", "FR", 48.8566, 2.3522, "EUR", 2.0),
    ("Berlin", "DE", 52.5200, 13.4050, "EUR", 2.0),
    ("Madrid", "ES", 40.4168, -3.7038, "EUR", 1.0),
    ("Amsterdam", "NL", 52.3676, 4.9041, "EUR", 1.0),
    ("Dublin", "IE", 53.3498, -6.2603, "EUR", 1.0),
    ("Zurich", "CH", 47.3769, 8.5417, "CHF", 1.0),
    ("Bucharest", "RO", 44.4268, 26.1025, "RON", 0.5),
    ("Dubai", "AE", 25.2048, 55.2708, "AED", 1.0),
    ("Lagos", "NG", 6.5244, 3.3792, "NGN", 1.0),
    ("Johannesburg", "ZA", -26.2041, 28.0473, "ZAR", 1.0),
    ("Mumbai", "IN", 19.0760, 72.8777, "INR", 2.0),
    ("Bengaluru", "IN", 12.9716, 77.5946, "INR", 2.0),
    ("Singapore", "SG", 1.3521, 103.8198, "SGD", 1.0),
    ("Hong Kong", "HK", 22.3193, 114.1694, "HKD", 1.0),
    ("Tokyo", "JP", 35.6762, 139.6503, "JPY", 2.0),
    ("Seoul", "KR", 37.5665, 126.9780, "KRW", 1.0),
    ("Sydney", "AU", -33.8688, 151.2093, "AUD", 2.0),
)

# Merchant categories (code, name, risk tier, share, median ticket, spread, online share).
CATEGORIES = (
    ("5411", "Grocery Stores & Supermarkets", "LOW", 0.17, 48.0, 0.60, 0.05),
    ("5812", "Restaurants", "LOW", 0.12, 38.0, 0.55, 0.02),
    ("5814", "Fast Food", "LOW", 0.11, 12.0, 0.45, 0.10),
    ("5541", "Fuel Stations", "LOW", 0.08, 42.0, 0.40, 0.00),
    ("5912", "Pharmacies", "LOW", 0.05, 25.0, 0.60, 0.10),
    ("4899", "Streaming & Subscriptions", "LOW", 0.03, 15.0, 0.30, 1.00),
    ("4121", "Taxis & Rideshare", "MEDIUM", 0.06, 22.0, 0.50, 0.90),
    ("5311", "Department Stores", "MEDIUM", 0.05, 75.0, 0.70, 0.40),
    ("5691", "Clothing Stores", "MEDIUM", 0.05, 65.0, 0.60, 0.50),
    ("5815", "Digital Goods & Media", "MEDIUM", 0.06, 11.0, 0.60, 1.00),
    ("5999", "Miscellaneous Retail", "MEDIUM", 0.07, 40.0, 0.80, 0.50),
    ("6011", "ATM Cash Withdrawal", "MEDIUM", 0.04, 120.0, 0.60, 0.00),
    ("4511", "Airlines", "MEDIUM", 0.02, 420.0, 0.60, 0.90),
    ("7011", "Hotels & Lodging", "MEDIUM", 0.02, 260.0, 0.60, 0.70),
    ("5732", "Electronics Stores", "HIGH", 0.04, 180.0, 0.90, 0.60),
    ("5944", "Jewelry & Watches", "HIGH", 0.01, 350.0, 0.90, 0.30),
    ("7995", "Gambling & Betting", "HIGH", 0.01, 90.0, 1.00, 0.90),
    ("6051", "Crypto & Quasi-Cash", "HIGH", 0.01, 250.0, 1.00, 1.00),
)

# Dollars per unit of each currency.
USD_PER_UNIT = {
    "USD": 1.0,
    "CAD": 0.73,
    "MXN": 0.055,
    "BRL": 0.18,
    "GBP": 1.27,
    "EUR": 1.09,
    "CHF": 1.13,
    "RON": 0.22,
    "AED": 0.272,
    "NGN": 0.00065,
    "ZAR": 0.055,
    "INR": 0.012,
    "SGD": 0.75,
    "HKD": 0.128,
    "JPY": 0.0068,
    "KRW": 0.00073,
    "AUD": 0.66,
}

# Dispute reasons (code, description, is fraud).
DISPUTE_REASONS = (
    ("10.1", "EMV Liability Shift Counterfeit Fraud", True),
    ("10.3", "Other Fraud - Card-Present Environment", True),
    ("10.4", "Other Fraud - Card-Absent Environment", True),
    ("12.6", "Duplicate Processing", False),
    ("13.1", "Merchandise/Services Not Received", False),
    ("13.3", "Not as Described or Defective Merchandise", False),
)

# Enumerations of the wire format.
CHANNELS = ("POS", "ECOM", "ATM")
ENTRY_MODES = ("CHIP", "CONTACTLESS", "SWIPE", "ECOM", "MANUAL")
NETWORKS = ("VISA", "MASTERCARD", "AMEX", "DISCOVER")
EARTH_RADIUS_KM = 6371.0088

FRAUD_REASONS = tuple(code for code, _, fraud in DISPUTE_REASONS if fraud)


def dispute_reasons(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DISPUTE_REASONS, "reason_code string, description string, is_fraud boolean")


def merchant_categories(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([c[:3] for c in CATEGORIES], "mcc string, category_name string, category_risk_tier string")


def currencies(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(USD_PER_UNIT.items()), "currency_code string, usd_per_unit double")


def locations(spark: SparkSession) -> DataFrame:
    """Cities with keys from 1, and the unknown place."""
    rows = [(k, c[0], c[1], c[2], c[3]) for k, c in enumerate(CITIES, 1)]
    return spark.createDataFrame([(-1, "UNKNOWN", "--", None, None), *rows], "location_key int, city string, country_code string, lat double, lon double")
