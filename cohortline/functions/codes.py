"""Code lists of the two fact families, and the configuration of curated years."""

from __future__ import annotations

from dataclasses import dataclass
# Codes and descriptions of the source data.
VEHICLE_CLASSES = {
    "PAU": "Personal automobile/light truck", "PMC": "Personal motorcycle", "PCY": "Personal moped", "PHM": "Personal motorhome",
    "CAU": "Commercial automobile/light truck", "CMC": "Commercial motorcycle", "CCY": "Commercial moped", "CHM": "Commercial motorhome",
    "TTA": "Taxi", "TAB": "Bus", "TAS": "School bus", "BCA": "Truck/road tractor", "CVO": "Tool vehicle", "COT": "Other commercial",
    "RAU": "Restricted automobile/light truck", "RMC": "Restricted motorcycle", "RCY": "Restricted moped", "RHM": "Restricted motorhome",
    "RAB": "Restricted bus", "RCA": "Restricted truck", "RMN": "Snowmobile", "ROT": "Other restricted",
    "HAU": "Off-road automobile/light truck", "HCY": "Off-road moped", "HAB": "Off-road bus", "HCA": "Off-road truck/road tractor",
    "HMN": "Off-road snowmobile", "HVT": "Off-road all-terrain vehicle (ATV)", "HVO": "Off-road tool vehicle", "HOT": "Other off-road",
    "UNK": "Unknown",
}
VEHICLE_TYPES = {
    "AB": "Bus", "AT": "Dealer Plates", "AU": "Automobile or Light Truck", "CA": "Truck or Road Tractor", "CY": "Moped", "HM": "Motorhome",
    "MC": "Motorcycle", "MN": "Snowmobile", "NV": "Other Off-Road Vehicle", "SN": "Snow Blower", "VO": "Tool Vehicle", "VT": "All-Terrain Vehicle", "UK": "Unknown",
}
FUEL_TYPES = {
    "L": "Electric", "E": "Gasoline", "D": "Diesel", "H": "Hybrid", "C": "Hydrogen", "P": "Propane", "N": "Natural Gas", "M": "Methanol",
    "T": "Ethanol", "W": "Plug-in Hybrid", "A": "Other", "S": "Non-powered", "U": "Unknown",
}
ADMIN_REGIONS = {
    "01": "Bas-Saint-Laurent", "02": "Saguenay–Lac-Saint-Jean", "03": "Capitale-Nationale", "04": "Mauricie", "05": "Estrie", "06": "Montréal",
    "07": "Outaouais", "08": "Abitibi-Témiscamingue", "09": "Côte-Nord", "10": "Nord-du-Québec", "11": "Gaspésie–Îles-de-la-Madeleine",
    "12": "Chaudière-Appalaches", "13": "Laval", "14": "Lanaudière", "15": "Laurentides", "16": "Montérégie", "17": "Centre-du-Québec",
}
AGE_GROUPS = ("16-19", "20-24", "25-34", "35-44", "45-54", "55-64", "65-74", "75+")
GENDERS = {"F": "Female", "M": "Male"}
LICENCE_TYPES = {"APPRENTI": "Learner's Permit", "PROBATOIRE": "Probationary License", "RÉGULIER": "Regular License"}
EXPERIENCE = ("Absente", "Moins de 2 ans", "2 à 5 ans", "6 à 9 ans", "10 ans ou plus")
LICENCE_CLASSES = {
    "1-2-3-4": "driver_1234", "5": "driver_5", "6A-6B-6C-6E": "driver_6abce", "6D": "driver_6d", "8": "driver_8",
    "Learner 1-2-3": "learner_123", "Learner 5": "learner_5", "Learner 6A-6R": "learner_6a6r", "Probationary": "probationary",
}
#: Fields whose presence can be measured, by their display names.
COVERAGE_FIELDS = {
    "Fuel Type": "fuel_type", "Vehicle Class": "vehicle_class", "Vehicle Make": "make", "Vehicle Model": "model", "Vehicle Color": "color",
    "Model Year": "model_year", "Vehicle Mass": "net_mass", "Engine Displacement": "displacement", "Cylinders": "cylinder_count",
    "Axle Count": "max_axles", "Admin Region": "admin_region", "MRC": "mrc", "Municipality": "municipality",
    "License Type": "licence_type", "Age Group": "age_group", "Gender": "gender",
}
AGE_PRESETS = ((-1, 5), (6, 10), (11, 15), (16, None))

# Schemas, as DDL.
REGISTRATIONS = (
    "year int, sequence string, vehicle_class string, vehicle_type string, make string, model string, model_year int, net_mass double, net_mass_int int, "
    "displacement double, displacement_int int, cylinder_count int, max_axles int, color string, fuel_type string, admin_region string, mrc string, municipality string"
)
LICENCES = (
    "year int, sequence string, age_group string, gender string, licence_type string, admin_region string, mrc string, learner_123 boolean, learner_5 boolean, "
    "learner_6a6r boolean, driver_1234 boolean, driver_5 boolean, driver_6abce boolean, driver_6d boolean, driver_8 boolean, probationary boolean, "
    "exp_1234 string, exp_5 string, exp_6abce string, exp_global string"
)
MAPPING = (
    "uncurated_make string, uncurated_model string, model_year int, canonical_make string, canonical_model string, fuel_type string, vehicle_type string, "
    "record_count bigint, year_start int, year_end int"
)


@dataclass(frozen=True)
class Years:
    """Which registration years are curated, which are not, and from when fuel types exist."""

    curated: tuple[int, ...] = tuple(range(2011, 2023))
    uncurated: tuple[int, ...] = (2023, 2024)
    fuel_from: int = 2017
