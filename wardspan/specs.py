"""Common schema, feature sets, recode tables and run settings."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

# Common column name -> name inside the engine.
COMMON_COLUMNS = {
    "ClusterID": "encounter_id",
    "ArrivalDateTime": "arrival_ts",
    "Age": "age",
    "Gender": "gender",
    "Ethnicity": "ethnicity",
    "Vital_Sign Respiratory Rate": "vital_respiratory_rate",
    "Vital_Sign Heart Rate": "vital_heart_rate",
    "Vital_Sign Systolic Blood Pressure": "vital_systolic_bp",
    "Vital_Sign Diastolic Blood Pressure": "vital_diastolic_bp",
    "Vital_Sign Oxygen Saturation": "vital_oxygen_saturation",
    "Vital_Sign Temperature Tympanic": "vital_temperature",
    "Vital_Sign Delivery device used": "vital_oxygen_device",
    "Blood_Test HAEMOGLOBIN": "blood_haemoglobin",
    "Blood_Test WHITE CELLS": "blood_white_cells",
    "Blood_Test PLATELETS": "blood_platelets",
    "Blood_Test MEAN CELL VOL.": "blood_mean_cell_vol",
    "Blood_Test NEUTROPHILS": "blood_neutrophils",
    "Blood_Test HAEMATOCRIT": "blood_haematocrit",
    "Blood_Test LYMPHOCYTES": "blood_lymphocytes",
    "Blood_Test MONOCYTES": "blood_monocytes",
    "Blood_Test EOSINOPHILS": "blood_eosinophils",
    "Blood_Test BASOPHILS": "blood_basophils",
    "Blood_Test SODIUM": "blood_sodium",
    "Blood_Test ALBUMIN": "blood_albumin",
    "Blood_Test ALK.PHOSPHATASE": "blood_alk_phosphatase",
    "Blood_Test ALT": "blood_alt",
    "Blood_Test UREA": "blood_urea",
    "Blood_Test BILIRUBIN": "blood_bilirubin",
    "Blood_Test CREATININE": "blood_creatinine",
    "Blood_Test eGFR": "blood_egfr",
    "Blood_Test POTASSIUM": "blood_potassium",
    "Blood_Test CRP": "blood_crp",
    "Blood_Test APTT": "blood_aptt",
    "Blood_Test Prothromb. Time": "blood_prothrombin_time",
    "Blood_Test INR": "blood_inr",
    "Blood_Gas pCO2 POC": "gas_pco2",
    "Blood_Gas O2 Sat (BG)": "gas_o2_sat",
    "Blood_Gas pO2 (BG)": "gas_po2",
    "Blood_Gas BE Std (BG)": "gas_base_excess",
    "Blood_Gas Bicarb (BG)": "gas_bicarbonate",
    "Blood_Gas Hct (BG)": "gas_haematocrit",
    "Blood_Gas K+ (BG)": "gas_potassium",
    "Blood_Gas Na+ (BG)": "gas_sodium",
    "Blood_Gas cLAC (BG)": "gas_lactate",
    "Blood_Gas Ca+ + (BG)": "gas_calcium",
    "Blood_Gas Hb (BG)": "gas_haemoglobin",
    "Blood_Gas Glucose (BG)": "gas_glucose",
    "Charlson Comorbidity Index": "charlson_index",
    "Discharged": "discharged",
    "Admission": "admission",
    "ICU": "icu",
    "death": "death",
    "Covid-19 Positive": "label",
}
DISPLAY_NAMES = {engine: common for common, engine in COMMON_COLUMNS.items()}

VITALS = [
    "vital_respiratory_rate",
    "vital_heart_rate",
    "vital_systolic_bp",
    "vital_temperature",
    "vital_oxygen_saturation",
    "vital_oxygen_device",
    "vital_diastolic_bp",
]
BLOOD_COUNT = [
    "blood_basophils",
    "blood_eosinophils",
    "blood_haematocrit",
    "blood_haemoglobin",
    "blood_lymphocytes",
    "blood_mean_cell_vol",
    "blood_monocytes",
    "blood_neutrophils",
    "blood_platelets",
    "blood_white_cells",
]
BLOOD_CHEMISTRY = [
    "blood_albumin",
    "blood_alk_phosphatase",
    "blood_alt",
    "blood_bilirubin",
    "blood_creatinine",
    "blood_crp",
    "blood_potassium",
    "blood_sodium",
    "blood_urea",
    "blood_egfr",
]
CLOTTING = ["blood_aptt", "blood_prothrombin_time"]
BLOOD_GASES = [name for name in COMMON_COLUMNS.values() if name.startswith("gas_")]
ALL_BLOODS = [name for name in COMMON_COLUMNS.values() if name.startswith("blood_")]
LAB_COLUMNS = [name for name in ALL_BLOODS if name != "blood_inr"] + BLOOD_GASES

# Feature columns of the encounters derived from the order tables.
ORDER_FEATURES = [
    "sum_qty",
    "avg_price",
    "max_price",
    "avg_discount",
    "avg_tax",
    "n_lines",
    "total_price",
    "account_balance",
]

# The published order of the blood tests and blood gases, in which weight vectors line up.
BLOODS_IN_ORDER = [
    "blood_albumin",
    "blood_alk_phosphatase",
    "blood_alt",
    "blood_aptt",
    "blood_basophils",
    "blood_bilirubin",
    "blood_creatinine",
    "blood_crp",
    "blood_eosinophils",
    "blood_haematocrit",
    "blood_haemoglobin",
    "blood_lymphocytes",
    "blood_mean_cell_vol",
    "blood_monocytes",
    "blood_neutrophils",
    "blood_platelets",
    "blood_potassium",
    "blood_prothrombin_time",
    "blood_sodium",
    "blood_urea",
    "blood_white_cells",
    "blood_egfr",
]
GASES_IN_ORDER = [
    "gas_base_excess",
    "gas_bicarbonate",
    "gas_calcium",
    "gas_lactate",
    "gas_glucose",
    "gas_haemoglobin",
    "gas_haematocrit",
    "gas_potassium",
    "gas_sodium",
    "gas_o2_sat",
    "gas_pco2",
    "gas_po2",
]

FEATURE_SETS: dict[str, list[str]] = {
    "OLO & Vitals": BLOOD_COUNT + VITALS,
    "Bloods & Vitals": [name for name in BLOODS_IN_ORDER if name not in CLOTTING] + VITALS,
    "Bloods & Blood_Gas & Vitals": BLOODS_IN_ORDER + GASES_IN_ORDER + VITALS,
    "Orders": ORDER_FEATURES,
}

# Ethnicity codes and labels by harmonised category.
ETHNICITY_GROUPS = {
    "White": [
        "A", "B", "C", "C2", "C3", "CA", "CB", "CC", "CF", "CH", "CHI", "CK", "CN", "CP", "CQ", "CR", "CS",
        "CU", "CW", "CY", "White - British", "White- British", "White- Irish",
        "White- Any other white background", "White - Any Other White Background",
    ],
    "South Asian": [
        "H", "J", "K", "Asian or Asian British - Pakistani", "Asian or Asian British - Indian",
        "Asian or Asian British -Indian", "Asian or Asian British - Bangladeshi",
    ],
    "Black": [
        "M", "N", "NK", "P", "PA", "PC", "PD", "PE", "Black- Any other black background",
        "Black or Black British - Caribbean",
    ],
    "Mixed": [
        "CX", "D", "E", "F", "G", "GA", "GB", "GD", "GE", "GF", "Mixed - White and Black African",
        "Mixed - White and Black Caribbean",
    ],
    "Chinese": ["R", "Other-Chinese"],
    "Other": [
        "L", "LA", "LD", "LE", "LG", "LH", "LJ", "LK", "S", "SA", "SC", "SD", "SE",
        "Other- Any other ethnic group", "Other - Any Other Ethnic Group",
        "Asian - Any Other Asian Background", "Asian or Asian British -Any other Asian background",
    ],
    "Unknown": [
        "Z", "Z9", "ZR", "WHT", "1", "19", "62", "87", "Other- Not stated", "Other - Not Stated",
        "Other- Not known", "Other - Not Known",
    ],
}
ETHNICITY_CODES = {code: group for group, codes in ETHNICITY_GROUPS.items() for code in codes}

# Oxygen support levels 0-3 by source coding. Lists are read in order of level and the
# first level that names a code wins.
DEVICE_TEXT_LEVELS = {
    1: ["NV", "VENTURI", "VM", "NEBULISER", "MASK", "FACEMASK", "NEB", "FM", "NIC", "NCX", "NC"],
    2: ["NRB", "NBM", "NRBM", "REBREATH", "NRM", "MRBM", "NON REBREATH"],
    3: ["CPAP", "NIV", "ETT", "NIPPY", "HIGH FLOW", "H FLOW", "NP", "NV"],
}
DEVICE_TEXT_INVALID = ["96"]
DEVICE_O2_LEVELS = {
    1: ["O2NASAL", "O2VENTURI", "O2TRACH", "O2RESPIFLO", "O2FACE"],
    2: ["O2NOREMASK"],
    3: ["O2NONINV", "O2HFF", "O2HFN"],
}
DEVICE_MASK_LEVELS = {
    0: ["0"],
    1: ["1", "2", "4", "16", "20", "28"],
    2: ["3", "8"],
    3: ["5", "6", "7", "9", "10", "14", "17", "18", "19", "21", "22", "23", "27", "29"],
}
DEVICE_FLOW_LEVELS = {
    0: ["Room Air"],
    1: [
        "1 l/min", "1 l/Min", "2 l/min", "3 l/min", "4 l/min", "5 l/min", "6 l/min", "7 l/min", "8 l/min",
        "9 l/min", "24%", "28%", "35%",
    ],
    2: ["10 l/min", "11 l/min", "12 l/min", "13 l/min", "14 l/min", "15 l/min", "40%"],
    3: ["50%", "60%", "80%", "100%"],
}


def level_map(*levels: Mapping[int, list[str]]) -> dict[str, int]:
    """Code -> level; the first list that names a code wins."""
    found: dict[str, int] = {}
    for table in levels:
        for level, codes in table.items():
            for code in codes:
                found.setdefault(code, level)
    return found


# Representative arrival times of the two period labels.
PERIOD_DATES = {"pre-pandemic": "2019-05-18 01:00:00", "pandemic": "2020-05-08 01:00:00"}

# Text results of the assay.
LABEL_TEXT = {"NOT Detected": 0, "**DETECTED**": 1, "***DETECTED***": 1}

OUTCOME_FLAGS = {0: "discharged", 1: "admission", 2: "icu", 3: "death"}
OUTCOME_FLAGS_DEATH_4 = {0: "discharged", 1: "admission", 2: "icu", 4: "death"}
OUTCOME_COLUMN = "Outcome (0=discharged, 1=ward admission, 2=ICU admission, 3=death)"
SEX_COLUMN = "SEX (1 = FEMALE, 0 = MALE)"
PCR_COLUMN = "SARS-CoV-2 PCR"
SECOND_ASSAY_COLUMN = "SAMBA Result (0 = INVALID, 1 = NEGATIVE, 2 = POSITIVE)"

# Raw column -> engine column for sites whose extract carries "Presentation..." names.
PRESENTATION_COLUMNS = {
    SEX_COLUMN: "gender",
    "AdmissionRespRate": "vital_respiratory_rate",
    "AdmissionHeartRate": "vital_heart_rate",
    "AdmissionBloodPressureSystolicBP": "vital_systolic_bp",
    "AdmissionBloodPressureDiastolicBP": "vital_diastolic_bp",
    "AdmissionSpO2": "vital_oxygen_saturation",
    "AdmissionTemperature": "vital_temperature",
    "AdmissionOxygenDeliveryDevice": "vital_oxygen_device",
    "PresentationHAEMOGLOBIN": "blood_haemoglobin",
    "PresentationWHITE CELLS": "blood_white_cells",
    "PresentationPLATELETS": "blood_platelets",
    "PresentationMEAN CELL VOL.": "blood_mean_cell_vol",
    "PresentationNEUTROPHILS": "blood_neutrophils",
    "PresentationHAEMATOCRIT": "blood_haematocrit",
    "PresentationLYMPHOCYTES": "blood_lymphocytes",
    "PresentationMONOCYTES": "blood_monocytes",
    "PresentationEOSINOPHILS": "blood_eosinophils",
    "PresentationBASOPHILS": "blood_basophils",
    "PresentationSODIUM": "blood_sodium",
    "PresentationALBUMIN": "blood_albumin",
    "PresentationALK.PHOSPHATASE": "blood_alk_phosphatase",
    "PresentationALT": "blood_alt",
    "PresentationUREA": "blood_urea",
    "PresentationBILIRUBIN": "blood_bilirubin",
    "PresentationCREATININE": "blood_creatinine",
    "PresentationeGFR": "blood_egfr",
    "PresentationPOTASSIUM": "blood_potassium",
    "PresentationCRP": "blood_crp",
    "PresentationAPTT": "blood_aptt",
    "PresentationProthromb. Time": "blood_prothrombin_time",
    "PresentationPOCT pC02": "gas_pco2",
    "PresentationPOCT sO2": "gas_o2_sat",
    "PresentationPOCT pO2": "gas_po2",
    "PresentationPCT cBASE(Ecf)c": "gas_base_excess",
    "PresentationPCT CO3(P,st)c": "gas_bicarbonate",
    "PresentationPOCT Hctc": "gas_haematocrit",
    "PresentationPOCT cK+": "gas_potassium",
    "PresentationPOCT cNA+": "gas_sodium",
    "PresentationPOCT cLAC": "gas_lactate",
    "PresentationPOCT cCA++": "gas_calcium",
    "PresentationPOCT ctHb": "gas_haemoglobin",
}
OUTCOME_SITE_COLUMNS = {
    "PresentationID (unique identifier)": "encounter_id",
    "PresentationDate": "arrival_ts",
    "AgeOnPresentation": "age",
    "EthnicityCode": "ethnicity",
    "PresentationGLUCOSE": "gas_glucose",
    **PRESENTATION_COLUMNS,
}
PERIOD_SITE_COLUMNS = {
    "StudyID": "encounter_id",
    "period": "arrival_ts",
    "Ethnicity": "ethnicity",
    "AGE ON PRESENTATION": "age",
    PCR_COLUMN: "label",
    "PresentationPOCT cGLU": "gas_glucose",
    **PRESENTATION_COLUMNS,
}

# Raw column -> engine column for the site with two recording systems.
DUAL_SITE_COLUMNS = {
    "epis_sg2": "encounter_id",
    "adm_age": "age",
    "gender": "gender",
    "ethnic_origin": "ethnicity",
    "charlson": "charlson_index",
    "ICU_adm": "icu",
    "ED Pulse": "vital_heart_rate",
    "ED resp_rate": "vital_respiratory_rate",
    "ED sys_bp": "vital_systolic_bp",
    "ED dia_bp": "vital_diastolic_bp",
    "ED Temp": "vital_temperature",
    "ED sats": "vital_oxygen_saturation",
    "ED O2 Flowrate": "vital_oxygen_device",
    "HB": "blood_haemoglobin",
    "WBC": "blood_white_cells",
    "PLT": "blood_platelets",
    "MCV": "blood_mean_cell_vol",
    "NEU": "blood_neutrophils",
    "HCT": "blood_haematocrit",
    "LYM": "blood_lymphocytes",
    "MON": "blood_monocytes",
    "EOS": "blood_eosinophils",
    "BAS": "blood_basophils",
    "NA": "blood_sodium",
    "ALB": "blood_albumin",
    "ALP": "blood_alk_phosphatase",
    "ALT": "blood_alt",
    "U": "blood_urea",
    "TBIL": "blood_bilirubin",
    "CR": "blood_creatinine",
    "INR": "blood_inr",
    "EGFR": "blood_egfr",
    "K": "blood_potassium",
    "PT": "blood_prothrombin_time",
    "CRP": "blood_crp",
    "APTT": "blood_aptt",
}
DUAL_SITE_FALLBACKS = {
    "ED sys_bp": "sys_bp",
    "ED dia_bp": "dia_bp",
    "ED Pulse": "pulse",
    "ED resp_rate": "resp_rate",
    "ED sats": "sats",
    "ED Temp": "TempR",
}
DUAL_SITE_DROPPED = [
    "YY", "MM", "pulse", "resp_rate", "sats", "sys_bp", "dia_bp", "TempR", "oxygen_mask", "RBC", "MPV", "ANRB",
    "CA", "COCA", "P", "GLHB", "DDIM", "MCHC", "MCH",
]


@dataclass(frozen=True)
class SiteSpec:
    """What one site contributes and which rules its rows follow."""

    name: str
    fits: bool = True
    train_from: str | None = None
    train_until: str | None = None
    validate_from: str | None = None
    scale_from: str | None = None

    @property
    def trains_only(self) -> bool:
        return self.fits and self.validate_from is None


@dataclass(frozen=True)
class RunSettings:
    """Settings of a federated run; the defaults are those of the published study."""

    features: tuple[str, ...] = tuple(FEATURE_SETS["Bloods & Vitals"])
    control_before: str = "2019-12-01"
    match_ratio: int = 10
    age_band: float = 4.0
    seed: int = 42
    test_share: float = 0.2
    target_metric: str = "recall"
    target_value: float = 0.85
    tolerance: float = 0.04
    level: float = 0.95
    lr_rounds: int = 15
    nn_rounds: int = 15
    #: "quasi-newton" steps from gradients alone, or "newton" steps with the Hessian from the same pass.
    lr_solver: str = "quasi-newton"
    lr_iterations: int = 5
    lr_c: float = 1.0
    #: "shards" of bounded size trained alone and averaged, or one fit over the whole "site" in synchronous steps.
    nn_solver: str = "shards"
    nn_hidden: int = 10
    nn_epochs: int = 50
    nn_patience: int = 15
    nn_batch: int = 4096
    nn_rows_per_shard: int = 20_000
    shap_background: int = 1000
    shap_explained: int = 400
    sites: tuple[SiteSpec, ...] = field(default_factory=tuple)

    @property
    def prevalence(self) -> float:
        return 1.0 / (self.match_ratio + 1)
