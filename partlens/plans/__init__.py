"""The four pipelines and the two log reports, as DataFrame plans."""
