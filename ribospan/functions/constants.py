"""Label sets that the score-table operators take where a caller gives none."""

# Disease keywords per tissue.
TISSUE_KEYWORDS = {
    "heart": [
        "Conotruncal Heart Malformations", "Cardiac Arrhythmia", "Hypertension",
        "Congenital Heart Disease", "Progressive Familial Heart Block", "Cardiomyopathy",
    ],
    "brain": [
        "Amyotrophic Lateral Sclerosis", "Neurodegenerative Disease", "Parkinson Disease",
        "Neurodegeneration", "Autism", "Alzheimer Disease", "Schizophrenia", "Depression", "Anxiety",
    ],
    "muscle": ["Muscular Dystrophy", "Atrophy"],
}

# Tissue of each cancer code.
CANCER_TO_TISSUE = {
    "GBM": "Brain", "LGG": "Brain", "KIRC": "Kidney", "KIRP": "Kidney", "KICH": "Kidney",
    "LUAD": "Lung", "LUSC": "Lung",
}

# Labels that name no disease.
INVALID_DISEASES = ["not_specified", "not_provided"]

# Diseases whose impact is summarised.
IMPACT_DISEASES = [
    "Hereditary_cancer-predisposing_syndrome",
    "Congenital_disorder_of_glycosylation",
    "Autosomal_recessive_cerebellar_ataxia",
    "Pheochromocytoma",
    "Leigh_syndrome",
    "Acute_intermittent_porphyria",
    "Coenzyme_Q10_deficiency,_Spinocerebellar_Ataxia_Type",
    "Coenzyme_Q10_deficiency,_primary,_4",
    "Cerebral_cavernous_malformations_2",
    "History_of_neurodevelopmental_disorder",
    "Mitochondrial_complex_II_deficiency",
]
