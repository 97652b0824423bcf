"""Defaults and word lists that results depend on."""

# Distances are planar, in degrees.
RADIUS = 0.02
KEEP_RADIUS = 0.06
GLOBAL_EPS_CENTS = 6
ROUND_BASE = 100
SPECTRUM_POINTS = 5
SPECTRUM_REACH_SQUARED = 1.0
SHARED_POINT_SHARE = 0.9
SHARED_CUSTOMER_SHARE = 1.0
SHARED_MIN_POINTS = 4
CHARACTERISTIC_MIN_POINTS = 4
KMEANS_SIZES = range(5, 161, 5)
KMEANS_TOLERANCE = 1e-6

DEFAULT_CURRENCY = 643
DEFAULT_MCC = 0
UNKNOWN_CITY = "UNKNOWN"

TRANSACTION_HEADER = "amount,atm_address,"
APARTMENT_HEADER = "latitude,longitude,year"

# Columns of the predictions, and the texts of a map document.
PREDICTION_COLUMNS = ["_ID_", "_WORK_LAT_", "_WORK_LON_", "_HOME_LAT_", "_HOME_LON_"]
SENTINEL_PRESET = "islands#blueIcon"
DOCUMENT_OPENING = '{"type": "FeatureCollection", "features": ['

# Input columns by position.
TEST_COLUMNS = [
    "amount", "atm_address", "atm_lat", "atm_lon", "city", "country", "currency",
    "customer_id", "mcc", "pos_address", "pos_lat", "pos_lon", "terminal_id", "date",
]
TRAIN_COLUMNS = [
    "amount", "atm_address", "atm_lat", "atm_lon", "city", "country", "currency",
    "customer_id", "home_lat", "home_lon", "mcc", "pos_address", "pos_lat", "pos_lon",
    "terminal_id", "date", "work_lat", "work_lon",
]
APARTMENT_COLUMNS = ["lat", "lon", "year", "floors", "units", "parking"]

# Spellings of the two cities that are merged, upper case.
CITY_NAMES = {
    "MOSCOW": [
        "MOSKVA", "MOSCOW", "MOSCOW REGION", "MOSKOW", "G MOSKVA", "G. MOSKOW", "G. MOSKVA",
        "*MOSCOW", "77 - MOSCOW",
    ],
    "ST-PETER": [
        "SANKT-PETERBU", "ST-PETERSBURG", "ST PETERSBURG", "ST PETERBURG", "ST-PETERBURG",
        "SAINT PETERSB", "ST.PETERSBURG", "SANKT-PETERSB", "SAINT-PETERSB", "SANKT-PETERS",
        "ST.-PETERSBUR", "SANKT PETERBU", "SPB", "G SANKT-PETER", "G. SANKT-PETE",
    ],
}

# Text replaced in every raw line before it is split.
LINE_REPAIRS = {
    '""""': '\\"',
    '"""Caf&#233","-bar Campus"""': '"Caf&#233", "-bar Campus"',
    '"""OSN.PR"," ZZ"""': '"OSN.PR","ZZ"',
    'TR BLD KAFE ""TU\\BOLSHAYA TARL\\423634    RUSRUS': 'TR BLD KAFE TU\\BOLSHAYA TARL\\423634    RUSRUS',
    'ALESYA"",MAG.""PELIKAN"",70 LET OKTYABRYA 41A\\TOGLIATTI\\445000    RUSRUS':
        'ALESYA,MAG.PELIKAN,70 LET OKTYABRYA 41A\\TOGLIATTI\\445000    RUSRUS',
    '207 SHOP "" LIGA""\\KARAGANDA\\KAZ       KAZKAZ': '207 SHOP  LIGA\\KARAGANDA\\KAZ       KAZKAZ',
    'TTS ""KROKUS SI\\MOSCOW\\123592    RUSRUS': 'TTS KROKUS SI\\MOSCOW\\123592    RUSRUS',
    'aya""': 'aya',
    '""MOSKVA-MINSK""': 'MOSKVA-MINSK',
    '""RADON""': 'RADON',
    '""Baltija""': 'Baltija',
    '""MOSKVA-SPB""': 'MOSKVA-SPB',
    'NSKAYA""': 'NSKAYA',
    'RUS"""': 'RUS"',
}

# Public holidays as (first day of year, last day of year, bucket).
HOLIDAYS = [
    (1, 8, 0),
    (53, 57, 1),
    (67, 67, 2),
    (118, 121, 3),
    (125, 129, 4),
    (160, 163, 5),
    (307, 310, 6),
]
HOLIDAY_BUCKETS = 8
