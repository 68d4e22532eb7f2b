"""Ordered dictionaries of the catalogue: the first entry that matches wins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Brands with their spellings, in order of precedence.
BRANDS: dict[str, list[str]] = {
    "Bosch": ["bosch", "bosh", "boch", "bosch auto parts"],
    "Mobil": ["mobil", "mobil1", "mobil 1", "mobil one"],
    "Mann": ["mann", "mann-filter", "mann filter", "mannfilter"],
    "Castrol": ["castrol", "castrol edge", "castrol magnatec"],
    "NGK": ["ngk", "ngk spark plugs"],
    "Denso": ["denso", "denso parts"],
    "ACDelco": ["acdelco", "ac delco", "gm parts"],
    "KYB": ["kyb", "kyb shocks", "kayaba"],
    "Monroe": ["monroe", "monroe shocks"],
    "Delphi": ["delphi", "delphi auto parts"],
    "Valeo": ["valeo", "valeo parts"],
    "Continental": ["continental", "contitech"],
    "Dayco": ["dayco", "dayco belts"],
    "Gates": ["gates", "gates belts"],
    "SKF": ["skf", "skf bearings"],
    "Timken": ["timken", "timken bearings"],
    "Federal Mogul": ["federal mogul", "federal-mogul"],
    "Mahle": ["mahle", "mahle filters"],
    "Mann+Hummel": ["mann+hummel", "mann hummel"],
    "Hengst": ["hengst", "hengst filters"],
    "K&N": ["k&n", "k and n", "kn filters"],
    "FRAM": ["fram", "fram filters"],
    "WIX": ["wix", "wix filters"],
    "Purolator": ["purolator", "purolator filters"],
    "Mopar": ["mopar", "mopar parts"],
    "Motorcraft": ["motorcraft", "ford parts"],
    "Genuine Toyota": ["genuine toyota", "toyota oem"],
    "Genuine Honda": ["genuine honda", "honda oem"],
    "Brembo": ["brembo", "brembo brakes"],
    "ATE": ["ate", "ate brakes"],
    "TRW": ["trw", "trw parts"],
    "Luk": ["luk", "luk clutch"],
    "Sachs": ["sachs", "sachs shocks"],
    "Bilstein": ["bilstein", "bilstein shocks"],
    "Koni": ["koni", "koni shocks"],
}

#: Brands that the reader knows, in lower case, in order of precedence.
READER_BRANDS = [
    "bosch", "denso", "ngk", "brembo", "mobil", "castrol",
    "bridgestone", "michelin", "continental", "valeo",
    "mann", "mahle", "ferodo", "akebono", "trw",
    "hella", "magneti marelli", "delphi", "acdelco", "motorcraft",
    "beck arnley", "gates", "dayco", "goodyear", "pirelli",
    "yokohama", "dunlop", "falken", "toyo", "hankook",
    "k&n", "fram", "purolator", "wix", "knorr", "wabco",
    "sachs", "zf", "bilstien", "monroe", "kyb",
    "ate", "textar", "pagid", "bendix", "raybestos",
    "champion", "autolite", "e3", "dens",
    "motul", "shell", "total", "petronas", "liqui moly",
    "valvoline", "penzoil", "amsoil", "royal purple",
]

#: Part categories with the keywords that name them, in order of precedence.
PART_KEYWORDS: dict[str, list[str]] = {
    "engine_oil": ["engine oil", "motor oil", "10w", "5w", "0w", "synthetic oil", "castrol", "mobil 1", "shell helix"],
    "air_filter": ["air filter", "air cleaner", "intake filter"],
    "cabin_filter": ["cabin filter", "pollen filter", "ac filter"],
    "fuel_filter": ["fuel filter", "gasoline filter"],
    "brake_fluid": ["brake fluid", "dot 3", "dot 4", "dot 5", "brake oil"],
    "coolant": ["coolant", "antifreeze", "radiator fluid"],
    "transmission_fluid": ["transmission fluid", "atf", "gear oil", "cvt fluid"],
    "power_steering_fluid": ["power steering fluid", "steering oil"],
    "wiper_blade": ["wiper blade", "windshield wiper", "wiper rubber"],
    "battery": ["battery", "accumulator", "12v battery"],
    "spark_plug": ["spark plug", "ignition plug"],
    "brake_pad": ["brake pad", "disc pad"],
    "oil_filter": ["oil filter"],
    "tire": ["tire", "tyre", "pneumatic"],
    "serpentine_belt": ["serpentine belt", "drive belt", "fan belt"],
    "timing_belt": ["timing belt", "cam belt"],
    "shock_absorber": ["shock absorber", "shock", "strut", "damper"],
    "headlight": ["headlight", "headlamp", "head light"],
    "taillight": ["taillight", "tail lamp", "rear light"],
    "muffler": ["muffler", "silencer", "exhaust"],
    "radiator": ["radiator"],
    "alternator": ["alternator", "generator"],
    "starter": ["starter", "starter motor"],
}

#: Categories with the detector classes that belong to them, in order of precedence, and what any vehicle is.
CLASS_KEYWORDS: dict[str, list[str]] = {
    "bumper": ["front_bumper", "rear_bumper"],
    "hood": ["hood"],
    "trunk": ["trunk"],
    "door": ["front_door", "rear_door"],
    "lighting": ["front_light", "rear_light", "headlights", "taillights"],
    "glass": ["front_windshield", "rear_windshield", "window_regulator"],
    "wheel": ["wheel", "rim"],
    "mirror": ["mirror", "side_mirror"],
    "grille": ["grille"],
    "spoiler": ["spoiler"],
    "brake": ["brake_pad", "brake_rotor", "brake_caliper", "vacuum_brake_booster"],
    "filter": ["oil_filter", "air_filter", "gasoline_filter"],
    "battery": ["battery"],
    "alternator": ["alternator", "starter", "ignition_coil", "spark_plug", "distributor", "oxygen_sensor", "oil_pressure_sensor", "fuse_box", "air_compressor"],
    "engine": ["piston", "engine_block", "cylinder_head", "camshaft", "crankshaft", "engine_valve", "valve_lifter", "fuel_injector", "carberator", "gas_cap", "transmission", "torque_converter", "clutch_plate", "pressure_plate", "oil_pan", "bearing", "chain", "clutch"],
    "exhaust": ["muffler"],
    "suspension": ["lower_control_arm", "idler_arm", "leaf_spring", "coil_spring"],
    "radiator": ["radiator", "radiator_hose", "radiator_fan", "overflow_tank", "water_pump", "thermostat"],
    "interior": ["radio", "instrument_cluster", "shift_knob"],
    "automotive": ["car", "vehicle", "truck", "motorcycle", "wheel", "tire"],
}

#: Listing categories and the label that each belongs to.
LEAF_LABELS: dict[str, str] = {
    "Oil Filters": "filters",
    "Air Filters": "filters",
    "Cabin Air Filters": "filters",
    "Fuel Filters": "filters",
    "Transmission Filters": "filters",
    "Spark Plugs": "battery and electrical",
    "Ignition Coils": "battery and electrical",
    "Other Ignition Systems & Components": "battery and electrical",
    "Alternators & Generators": "battery and electrical",
    "Air Intake & Fuel Sensors": "engine and powertrain",
    "Idlers & Tensioners": "engine and powertrain",
    "Brake Pads": "braking",
    "Brake Disc Rotors": "braking",
    "Light Bulbs & LEDs": "lighting",
    "Control Arms, Ball Joints & Assemblies": "suspension and steering",
    "Wheel Bearings, Hubs & Seals": "suspension and steering",
    "Shocks, Struts & Assemblies": "suspension and steering",
    "Tie Rods & Steering Linkages": "suspension and steering",
    "Water Pumps": "cooling",
    "Thermostats & Housings": "cooling",
}

#: What stands for no part number, and for no brand.
JUNK_NUMBERS = ["", "NA", "NONE", "DOESNOTAPPLY", "NOTAPPLICABLE", "UNKNOWN", "UNBRANDED", "SEEDESCRIPTION", "0"]
NO_BRANDS = ["", "unbranded", "does not apply", "n/a", "generic"]


#: Other spellings of detector classes, as they are compared, and the classes they stand for; None: none. What
#: stands for itself is left out.
CLASS_ALIASES: dict[str, str | None] = {
    "back_bumper": "rear_bumper",
    "back_door": "rear_door",
    "back_glass": "rear_windshield",
    "back_left_door": "rear_door",
    "back_left_light": "rear_light",
    "back_light": "rear_light",
    "back_right_door": "rear_door",
    "back_right_light": "rear_light",
    "front_glass": "front_windshield",
    "front_left_door": "front_door",
    "front_left_light": "front_light",
    "front_right_door": "front_door",
    "front_right_light": "front_light",
    "left_mirror": "mirror",
    "right_mirror": "mirror",
    "tailgate": "trunk",
    "headlamp": "headlights",
    "head_light": "headlights",
    "taillamp": "taillights",
    "tail_light": "taillights",
    "brake_disc": "brake_rotor",
    "carburetor": "carberator",
    "carb": "carberator",
    "damaged_spark_plug": "spark_plug",
    "brake_shoes": "brake_pad",
    "clutch_lever": "clutch_plate",
    "clutch": "clutch_plate",
    "front_brake": "brake_pad",
    "rear_brake": "brake_pad",
    "gasoline_filter": "fuel_injector",
    "motor": "starter",
    "rearview_mirror": "side_mirror",
    "front_sprocket": "chain",
    "crown": "engine_block",
    "retainers": "valve_lifter",
    "d008": None,
    "d228": None,
    "isimsiz": None,
}


def as_table(spark: SparkSession, entries: dict[str, list[str]]) -> DataFrame:
    """``(name, name_pos, alias, alias_pos)``: a dictionary as rows, with the order that decides precedence."""
    rows = [(n, i, a, j) for i, (n, aliases) in enumerate(entries.items()) for j, a in enumerate(aliases)]
    return spark.createDataFrame(rows, "name string, name_pos int, alias string, alias_pos int")


def add_entry(entries: dict[str, list[str]], name: str, aliases: list[str]) -> dict[str, list[str]]:
    """A copy with `name` added or replaced; aliases in lower case."""
    return {**entries, name: [a.lower() for a in aliases]}


def remove_entry(entries: dict[str, list[str]], name: str) -> dict[str, list[str]]:
    return {n: a for n, a in entries.items() if n != name}
